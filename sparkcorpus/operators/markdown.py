"""Article JSON with an HTML body as Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcorpus.functions.text import metadata_appendix, strip

_PARAGRAPHS = frozenset("p div section article blockquote figure table header footer main aside dl".split())


class _Writer(HTMLParser):
    """Markdown with # headings and - lists; scripts and styles are left out, * and _ in the text stay as they are."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.links: list[tuple[int, str | None]] = []
        self.hidden = self.pre = 0
        self.row: list[str] | None = None
        self.rows = 0

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.out.append("\n" if self.lists else "\n\n")
            self.lists.append([tag, int(values.get("start") or 1) if (values.get("start") or "1").isdigit() else 1])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 1]
            mark = "- " if kind[0] == "ul" else f"{kind[1]}. "
            kind[1] += 1
            self.out.append("\n" + "  " * max(len(self.lists) - 1, 0) + mark)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "a":
            self.links.append((len(self.out), values.get("href")))
        elif tag == "img":
            self.out.append(f"![{values.get('alt') or ''}]({values.get('src') or ''})")
        elif tag == "tr":
            self.out.append("\n|")
            self.rows, self.row = self.rows + 1, []
        elif tag in ("td", "th"):
            self.out.append(" ")
            if self.row is not None:
                self.row.append("---")
        if tag in _PARAGRAPHS:
            self.out.append("\n\n")
        if tag == "table":
            self.rows = 0

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in _PARAGRAPHS:
            self.out.append("\n\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("" if self.lists else "\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "a" and self.links:
            at, href = self.links.pop()
            label = "".join(self.out[at:])
            del self.out[at:]
            self.out.append(f"[{label.strip()}]({href})" if href and label.strip() else label)
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag == "tr" and self.row is not None:
            if self.rows == 1:
                self.out.append("\n| " + " | ".join(self.row or ["---"]) + " |")
            self.row = None

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None) -> str:
    """Markdown of an HTML body; null and blank bodies give ''."""
    if not html or not html.strip():
        return ""
    writer = _Writer()
    writer.feed(html)
    writer.close()
    text = "".join(writer.out)
    text = re.sub(r"(?m)^ +(?=[^\s\-0-9])|(?<=\S) +$(?<!  )", "", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)^[ \t]+$", "", text)).strip()


@F.pandas_udf(T.StringType())
def markdown_of(bodies: pd.Series) -> pd.Series:
    return bodies.map(html_to_markdown)


ARTICLE_JSON = "id bigint, title string, xhtml_body string, url string, changed_at string, created_at string, metadata map<string,string>"


def article_markdown(df: DataFrame, json_col: str, include_metadata: bool = True) -> DataFrame:
    """Article JSON as columns with ``xhtml_md`` and ``valid``.

    A row is valid if its JSON is well formed and has id, title and xhtml_body; others get a null text and stay. The
    appendix lists id, title, url, time and further metadata.
    """
    rows = df.withColumn("a", F.from_json(F.col(json_col), ARTICLE_JSON, {"mode": "PERMISSIVE"}))
    a = F.col("a")
    valid = F.coalesce(a["id"].isNotNull() & a["title"].isNotNull() & a["xhtml_body"].isNotNull(), F.lit(False))
    body = markdown_of(a["xhtml_body"])
    if include_metadata:
        body = strip(F.concat(body, metadata_appendix(a["id"], a["title"], a["url"], a["changed_at"], a["metadata"])))
    rest = [c for c in df.columns if c not in ("a", "xhtml_md", "valid")]
    return rows.withColumn("valid", valid).withColumn("xhtml_md", F.when(F.col("valid"), body)).select(*rest, "a.*", "valid", "xhtml_md")
