"""Text functions as Catalyst expressions: stripping, Markdown sections, chunks, prefixes, metadata, answer parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcorpus.functions.timestamps import strip

__all__ = ["strip"]

def footer_of(site: str) -> str:
    """Pattern of the footer with which a site's articles end; fixed but for the site's name."""
    return rf"(?isuU)#*Læs\s+mere\si\s{re.escape(site)}.*$"


#: Headings of sections that hold only links.
_LINK_SECTIONS = (r"Se\s+også", r"Relateret", r"Eksterne\s+links?", r"External\s+links?", r"Det\s+sker")


def boilerplate_of(site: str | None) -> list[str]:
    """Patterns of what clean Markdown leaves out: sections of links, and mentions of the site's own pages."""
    own = [rf"Læs\s+mere\s+i\s+{re.escape(site)}"] if site else []
    heads = [rf"(?isuU)#{{2,6}}\s+{name}.*?(?=#{{1,6}}\s|\z)" for name in [*own, *_LINK_SECTIONS]]
    return heads + [rf"(?isuU){name}\s*:\s*" for name in own]


_OPEN, _SHUT = "\u0001", "\u0002"


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space texts."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def clean_markdown(text: Column, site: str | None = None) -> Column:
    """Without link sections; runs of blank lines become one. Null gives ''. ``site``: the name under which a site's own pages are mentioned."""
    out = F.coalesce(text, F.lit(""))
    for pattern in boilerplate_of(site):
        out = F.regexp_replace(out, pattern, "")
    return strip(F.regexp_replace(out, "\n\n\n+", "\n\n"))


def _marked(text: Column, levels: int, anchored: bool) -> Column:
    start = "(?m)^" if anchored else ""
    return F.split(F.regexp_replace(F.translate(text, _OPEN + _SHUT, ""), rf"(?U){start}(#{{1,{levels}}}\s+[^\n]+)", f"{_OPEN}$1{_SHUT}"), _OPEN)


def _heading(part: Column) -> Column:
    return strip(F.split_part(part, F.lit(_SHUT), F.lit(1)))


def _content(part: Column) -> Column:
    return strip(F.split_part(part, F.lit(_SHUT), F.lit(2)))


def sections(text: Column, site: str | None = None, anchored: bool = False) -> Column:
    """array<string>: heading and content of each section of level 1 to 3, first occurrences only.

    Text before the first heading is no section. Blank and null texts have none. ``anchored`` takes only marks at the
    start of a line for headings. ``site``: its footer, and all behind it, goes first.
    """
    body = F.regexp_replace(text, footer_of(site), "") if site else text
    # the footer goes before the cut, so that a heading inside it is none
    parts = F.slice(_marked(body, 3, anchored), 2, 1_000_000)
    joined = F.transform(parts, lambda p: strip(F.concat(_heading(p), F.lit("\n"), _content(p))))
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(joined, lambda s: s != "")))


def sections_with_headings(text: Column, site: str | None = None) -> Column:
    """array<struct<heading, content>> of sections of level 1 to 6; text before the first heading has heading ''."""
    body = F.regexp_replace(text, footer_of(site), "") if site else text
    parts = _marked(body, 6, False)
    pair = lambda h, c: F.struct(h.alias("heading"), c.alias("content"))
    first = F.filter(F.array(pair(F.lit(""), strip(parts[0]))), lambda s: s["content"] != "")
    rest = F.transform(F.slice(parts, 2, 1_000_000), lambda p: pair(_heading(p), _content(p)))
    return F.when(is_blank(text), F.slice(F.array(pair(F.lit(""), F.lit(""))), 1, 0)).otherwise(F.array_distinct(F.concat(first, rest)))


def tokenize(text: Column) -> Column:
    """Words between white space; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def reconstruct(tokens: Column) -> Column:
    """Words joined with spaces, none before closing punctuation or after an opening bracket or quote."""
    tight = F.array(*[F.lit(c) for c in (",", ".", "!", "?", ";", ":", ")", "]", "}", '"', "'")])
    opening = F.array(*[F.lit(c) for c in ("(", "[", "{", '"', "'")])
    glue = lambda acc, t: F.when((acc == "") | F.array_contains(tight, t) | F.array_contains(opening, F.right(acc, F.lit(1))), F.lit("")).otherwise(F.lit(" "))
    return F.aggregate(tokens, F.lit(""), lambda acc, t: F.concat(acc, glue(acc, t), t))


def _starts(size: Column, length: int, overlap: int) -> Column:
    step = length - overlap
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((size - length) / step).cast("int")) * step, F.lit(step))


def _check(length: int, overlap: int) -> None:
    if overlap < 0 or length <= overlap:
        raise ValueError("the chunk size must exceed the overlap")


def chars(text: Column, length: int, overlap: int) -> Column:
    """array<string>: pieces of ``length`` characters, each ``overlap`` into the one before; '' and null have none."""
    _check(length, overlap)
    pieces = F.transform(_starts(F.char_length(text), length, overlap), lambda s: F.substring(text, s + 1, F.lit(length)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(pieces)


def words(text: Column, length: int, overlap: int) -> Column:
    """array<string>: pieces of ``length`` words joined by spaces; a text within the length stays as it is."""
    _check(length, overlap)
    tokens = tokenize(text)
    pieces = F.transform(_starts(F.size(tokens), length, overlap), lambda s: F.array_join(F.slice(tokens, s + 1, F.lit(length)), " "))
    return F.when(is_blank(text), F.array().cast("array<string>")).when(F.size(tokens) <= length, F.array(text)).otherwise(pieces)


def truncate_words(text: Column, most: int) -> Column:
    """The text where it has at most so many words, else its first ones joined by spaces."""
    tokens = tokenize(text)
    return F.when(F.size(tokens) <= most, text).otherwise(F.array_join(F.slice(tokens, 1, most), " "))


def title_key(key: Column) -> Column:
    """snake_case as Title Case."""
    return F.initcap(F.translate(key, "_", " "))


def metadata_appendix(id_: Column, title: Column, url: Column, changed_at: Column, metadata: Column) -> Column:
    """The Markdown section that lists an article's metadata; null or empty url, time and map are left out."""
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"**{name}:** "), value))
    extra = F.concat(F.lit("\n**Additional Metadata:**\n"), F.array_join(F.transform(F.map_entries(metadata), lambda e: F.concat(F.lit("- **"), title_key(e["key"]), F.lit(":** "), F.coalesce(e["value"], F.lit("None")))), "\n"))
    body = F.concat_ws("\n", F.lit("\n---\n\n## Article Metadata\n"), F.concat(F.lit("**Article ID:** "), id_.cast("string")), F.concat(F.lit("**Title:** "), title), line("URL", url), line("Last Modified", changed_at), F.when(F.size(metadata) > 0, extra))
    return body


#: What a model wants before queries and passages.
PREFIXES = {"e5": ("query: ", "passage: "), "jina": ("Query: ", "Document: "), "plain": ("", "")}


def prefixed(text: Column, kind: Column, family: str) -> Column:
    """A text with the prefix of its kind (query or passage)."""
    query, passage = PREFIXES[family]
    return F.concat(F.when(kind == "query", F.lit(query)).otherwise(F.lit(passage)), text)


def _bare(text: Column) -> Column:
    """Without white space at either end, the separators U+001C to U+001F included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def parse_answer(content: Column) -> Column:
    """struct<query_type, passage> of a generated answer.

    With both marks present, the last QUERYTYPE line decides (entity, conceptual, else unclear) and the passage is every
    line from the first PASSAGE line on, joined by spaces. Without them the whole answer is the passage and the type is
    conceptual. A null answer gives a null passage.
    """
    text = _bare(content)
    lines = F.split(text, "\n")
    typed = F.upper(F.element_at(F.filter(lines, lambda x: x.startswith("QUERYTYPE:")), -1))
    both = text.contains("QUERYTYPE:") & text.contains("PASSAGE:")
    kind = F.when(~both, "conceptual").when(typed.contains("ENTITY"), "entity").when(typed.contains("CONCEPTUAL"), "conceptual").otherwise("unclear")
    first = F.array_position(F.transform(lines, lambda x: x.startswith("PASSAGE:")), True)
    kept = F.filter(F.when(first > 0, F.slice(lines, first.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>")), lambda x: ~x.startswith("QUERYTYPE:"))
    body = _bare(F.array_join(F.transform(kept, lambda x: F.when(x.startswith("PASSAGE:"), _bare(F.replace(x, F.lit("PASSAGE:"), F.lit("")))).otherwise(x)), " "))
    return F.struct(kind.alias("query_type"), F.when(both & (first > 0), body).otherwise(text).alias("passage"))
