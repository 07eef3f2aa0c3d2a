"""Splitting documents into chunks by characters, words, sections or sentences."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcorpus.functions import text as tx
from sparkcorpus.functions.tokens import MakeEncoder, token_windows

STRATEGIES = ("tokens", "characters", "sections", "semantic_chunks")
# Abbreviations behind which a sentence goes on.
_ABBREVIATIONS = frozenset("bl.a ca dr dvs f.eks fr hr jf kap kl m.fl mio mia nr osv pct prof s sml st t vol".split())
_END = re.compile(r"(?<=[.!?])[»«”\"')\]]*\s+(?=[»«„“\"'(\[]*[A-ZÆØÅ0-9])")
_TIGHT = frozenset(",.!?;:)]}\"'")
_OPENING = frozenset("([{\"'")


def split_sentences(text: str) -> list[str]:
    """Sentences of a Danish text: after . ! ? before a capital or digit, not behind an abbreviation or an ordinal."""
    out, start = [], 0
    for m in _END.finditer(text):
        word = text[start : m.start()].rsplit(None, 1)[-1:] or [""]
        last = word[0].rstrip(".").lower()
        if word[0].endswith(".") and (last in _ABBREVIATIONS or (last.isdigit() and len(last) < 3)):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    return [s for s in [*out, text[start:].strip()] if s]


def _joined(words: list[str]) -> str:
    out = ""
    for w in words:
        out += w if not out or w in _TIGHT or out[-1] in _OPENING else " " + w
    return out


def pack_sentences(heading: str, content: str, least: int = 5, size: int = 250, overlap: int = 30) -> list[str]:
    """Greedy chunks of whole sentences of one section.

    Fewer than ``least`` words give none, fewer than ``size`` give one. A chunk is closed before the sentence that would
    fill it, if it has ``least`` words; the next begins with its last sentences of at most ``overlap`` words. A rest
    below ``least`` is left out, and a sentence is never divided. The heading leads a first chunk that begins in lower
    case.
    """
    sentences = [s.split() for s in split_sentences(content)]
    # words before each sentence; where a chunk ends and the next begins are places in these sums
    sums = [0, *accumulate(map(len, sentences))]
    ranges, start, at = [], 0, -1
    while sums[-1] >= size:
        at = max(at + 1, bisect_left(sums, sums[start] + least), bisect_left(sums, sums[start] + size) - 1)
        if at >= len(sentences):
            break
        ranges.append((start, at))
        start = bisect_left(sums, sums[at] - overlap, start, at)
    if sums[-1] - sums[start] >= least:
        ranges.append((start, len(sentences)))
    out = [_joined([w for s in sentences[a:b] for w in s]) for a, b in ranges]
    if out and heading and out[0][:1].islower():
        out[0] = f"{heading} {out[0]}"
    return out


def _semantic(size: int, overlap: int, least: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def packed(parts: pd.Series) -> pd.Series:
        def one(sections) -> list[str]:
            return [c for s in (sections if sections is not None else []) for c in pack_sentences(s["heading"].lstrip("#").strip(), s["content"], least, size, overlap)]

        return parts.map(one)

    return packed


def chunks(text: Column, strategy: str, size: int, overlap: int, least: int = 5, encoder: MakeEncoder | None = None, site: str | None = None) -> Column:
    """array<string>: the chunks of a text by an index's strategy; an unknown one is an error.

    "tokens" counts the tokens of ``encoder``, and white-space words without one. ``site`` names the site whose footers are cut.
    """
    if strategy == "characters":
        return tx.chars(text, size, overlap)
    if strategy == "tokens":
        return token_windows(text, size, overlap, encoder) if encoder else tx.words(text, size, overlap)
    if strategy == "sections":
        return tx.sections(text, site)
    if strategy == "semantic_chunks":
        return _semantic(size, overlap, least)(tx.sections_with_headings(tx.clean_markdown(text, site), site))
    raise ValueError(f"unknown chunking strategy: {strategy}")


def chunked(df: DataFrame, id_col: str, text_col: str, strategy: str, size: int, overlap: int, encoder: MakeEncoder | None = None, site: str | None = None) -> DataFrame:
    """source_article_id, chunk_sequence_id (from 0), chunk_text of every chunk; blank chunks are left out but counted.

    Texts that give no chunk have no row.
    """
    parts = chunks(F.col(text_col), strategy, size, overlap, encoder=encoder, site=site)
    rows = df.select(F.col(id_col).alias("source_article_id"), F.posexplode(parts).alias("chunk_sequence_id", "chunk_text"))
    return rows.where(~tx.is_blank(F.col("chunk_text")))
