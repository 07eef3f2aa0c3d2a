"""Tokens of a model's tokenizer, given as an encoder that each worker makes once."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Encoder(Protocol):
    """Ids of a text without special tokens, and the text of ids."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


#: Makes an encoder in a worker; it must be picklable and equal for equal encoders.
MakeEncoder = Callable[[], Encoder]


class _File:
    """A tokenizer file of the public ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        # the strings of special tokens are ordinary text in a text
        self.inner.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        return self.inner.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.inner.decode(ids, skip_special_tokens=True)


_files: dict[str, _File] = {}


def _load(path: str) -> _File:
    if path not in _files:
        _files[path] = _File(path)
    return _files[path]


def tokenizer_file(path: str) -> MakeEncoder:
    """An encoder from a tokenizer file that every worker can read at ``path``."""
    return partial(_load, path)


def windows(encoder: Encoder, text: str | None, size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size`` tokens, each ``overlap`` tokens into the one before; a text within the size stays as it is."""
    if not text:
        return []
    ids = encoder.encode(text)
    if len(ids) <= size:
        return [text]
    return [encoder.decode(ids[at : at + size]) for at in range(0, len(ids) - overlap, size - overlap)]


def truncated(encoder: Encoder, text: str, most: int) -> str:
    """The text where it has at most so many tokens, else its first ones."""
    ids = encoder.encode(text)
    return text if len(ids) <= most else encoder.decode(ids[:most])


def token_count(text: Column, make: MakeEncoder | None = None) -> Column:
    """Tokens of a text (0 for null and empty). Without an encoder a quarter of the characters, rounded down."""
    if make is None:
        return F.coalesce(F.floor(F.char_length(text) / 4), F.lit(0)).cast("long")

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = make().encode
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)


def token_windows(text: Column, size: int, overlap: int, make: MakeEncoder) -> Column:
    """array<string> of ``windows``; null and empty texts have none."""
    if overlap < 0 or size <= overlap:
        raise ValueError("the chunk size must exceed the overlap")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        encoder = make()
        return texts.map(lambda t: windows(encoder, t, size, overlap))

    return cut(text)


def truncate_tokens(text: Column, most: int, make: MakeEncoder) -> Column:
    """``truncated``; null stays null."""

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        encoder = make()
        return texts.map(lambda t: None if t is None else truncated(encoder, t, most))

    return cut(text)
