"""Splitting oversized texts into balanced pieces at natural boundaries, with a fixed overlap.

The minimum number of pieces gives equal-length targets; each cut moves to the strongest boundary near its target
(blank line, line end, sentence end, clause, word, letter). Where a piece would then exceed the limit, one piece is
added and the text is cut anew. All lengths are in characters (Unicode code points).
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcorpus.llm.arrow import map_rows, spread

_BOUNDARIES = re.compile(r"(?P<block>\n[ \t]*\n\s*|\n(?=#{1,6} ))|(?P<line>\n\s*)|(?P<sentence>[.!?…]+[\"'»”’)\]]*[ \t]+|[。！？।؟]+[」』”’）]*[ \t]*)|(?P<clause>[,;:–—،؛][ \t]+|[、，；：]|[ \t]+(?=[–—(]))|(?P<word>[ \t]+)")
_STRENGTH = {"block": 5, "line": 4, "sentence": 3, "clause": 2, "word": 1}


def _splits_letter(text: str, at: int) -> bool:
    return 0 < at < len(text) and (unicodedata.combining(text[at]) != 0 or unicodedata.category(text[at]) in ("Mn", "Mc", "Me") or text[at] in "‍️" or text[at - 1] == "‍")


def _snap(text: str, lo: int, target: int, hi: int) -> int:
    """The strongest boundary in lo..hi; the nearest to the target among equals."""
    best = (0, 0, max(lo, min(target, hi)))
    for m in _BOUNDARIES.finditer(text, max(lo - 8, 0), min(hi + 8, len(text))):
        if lo <= m.end() <= hi:
            best = max(best, (_STRENGTH[m.lastgroup], -abs(m.end() - target), m.end()))
    at = best[2]
    if not best[0]:
        while at > lo and _splits_letter(text, at):
            at -= 1
    return at


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of the pieces, each at most ``limit`` long, each beginning ``overlap`` before the end of the last.

    An empty text has no piece and one within the limit is one piece. The union of the pieces is the whole text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    size = len(text)
    if size <= limit:
        return [(0, size)] if size else []
    count = -(-(size - overlap) // (limit - overlap))
    while True:
        step = (size - overlap) / count
        reach = int(max(1, min(step / 2, limit / 4)))
        out, start = [], 0
        for k in range(1, count):
            target = overlap + round(k * step)
            hi = min(target + reach, start + limit, size - 1)
            lo = max(target - reach, start + overlap + 1)
            if lo > hi:
                break
            end = _snap(text, lo, target, hi)
            out.append((start, end))
            start = end - overlap
        else:
            if size - start <= limit:
                return [*out, (start, size)]
        count += 1


def split_oversized(df: DataFrame, text: str, limit: int, overlap: int, cuts: str = "cuts", keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """Rows of ``df`` whose text exceeds ``limit`` characters, with ``cuts``: array<struct<start, end, piece_text>>.

    ``keep``: the columns carried along (default all but the text). Without ``with_text`` a piece has its range only.
    Each text is read once, however many pieces it has, and is not carried along beside them. Texts within the limit
    never reach Python; null texts are no rows. Repeated rows stay repeated; a column named like ``cuts`` is replaced.
    """
    keep = [c for c in (keep or df.columns) if c not in (text, cuts)]
    names = ["start", "end"] + (["piece_text"] if with_text else [])
    piece = T.StructType([T.StructField(n, T.StringType() if n == "piece_text" else T.IntegerType()) for n in names])
    rows = spread(df.select(*keep, text), keep or [text]).where(F.char_length(F.col(text)) > limit)
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(cuts, T.ArrayType(piece))])

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        found = [[dict(zip(names, (a, b, t[a:b]))) for a, b in cut(t, limit, overlap)] for t in batch.column(text).to_pylist()]
        return {c: batch.column(c) for c in keep} | {cuts: found}

    return map_rows(rows, schema, work)


def pieces(df: DataFrame, cuts: str = "cuts", number: str = "chunk_sequence_id", first: int = 0) -> DataFrame:
    """One row for each piece of ``split_oversized``: its number (from ``first``), start_char, end_char and piece_text."""
    rest = [c for c in df.columns if c not in (cuts, number, "start_char", "end_char", "piece_text")]
    out = df.select(*rest, F.posexplode(cuts).alias("__at", "__piece"))
    at = F.col("__piece")
    return out.select(*rest, (F.col("__at") + first).alias(number), at["start"].alias("start_char"), at["end"].alias("end_char"), at["piece_text"].alias("piece_text"))
