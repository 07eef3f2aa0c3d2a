"""Embedding providers, the limits they keep, and embedding of whole tables."""

from __future__ import annotations

import hashlib
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcorpus.functions.text import is_blank

#: Dimensions of the models.
DIMENSIONS = {
    "intfloat/multilingual-e5-small": 384,
    "intfloat/multilingual-e5-large": 1024,
    "jinaai/jina-embeddings-v5-text-small": 1024,
    "jinaai/jina-embeddings-v5-text-nano": 768,
    "text-embedding-ada-002": 1536,
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "mock_model": 4,
}


def dimensions(model: str) -> int:
    if model not in DIMENSIONS:
        raise ValueError(f"unknown model: {model}")
    return DIMENSIONS[model]


class Provider(Protocol):
    """Gives one vector for each text, in order."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Deterministic bag of hashed words, unit length: stands in where no model can be loaded."""

    def __init__(self, dims: int):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()) or [text]:
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[row, h % self.dims] += 1 if h >> 63 else -1
            if not out[row].any():
                out[row, 0] = 1
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).tolist()


class RetryingProvider:
    """Another provider behind batches, a limiter and retries with doubling pauses; results keep the order of the texts."""

    def __init__(self, inner: Provider, batch: int = 64, attempts: int = 4, pause: float = 1.0, limiter: WindowLimiter | None = None, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.batch, self.attempts, self.pause, self.limiter, self.sleep = inner, batch, attempts, pause, limiter, sleep

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            some = texts[at : at + self.batch]
            if self.limiter:
                self.limiter.wait(sum(len(t) // 4 for t in some))
            for attempt in range(self.attempts):
                try:
                    found = self.inner.embed(some)
                    break
                except (OSError, TimeoutError):
                    if attempt + 1 == self.attempts:
                        raise
                    self.sleep(self.pause * 2**attempt)
            if len(found) != len(some):
                raise ValueError("the provider left out vectors")
            out += found
        return out


class WindowLimiter:
    """At most so many requests and tokens within any window of ``seconds``."""

    def __init__(self, requests: int = 9_000, tokens: int = 40_000_000, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.requests, self.tokens, self.seconds, self.clock, self.sleep = requests, tokens, seconds, clock, sleep
        self.past: deque[tuple[float, int]] = deque()

    def wait(self, tokens: int) -> None:
        while True:
            now = self.clock()
            while self.past and now - self.past[0][0] >= self.seconds:
                self.past.popleft()
            if not self.past or (len(self.past) < self.requests and sum(t for _, t in self.past) + tokens <= self.tokens):
                self.past.append((now, tokens))
                return
            self.sleep(self.seconds - (now - self.past[0][0]))


_providers: dict[tuple, Provider] = {}


def provider(model: str, make: Callable[[str], Provider] | None = None) -> Provider:
    """The process's provider of a model, made once; without ``make`` the hashing one in the model's dimension."""
    key = (model, make)
    if key not in _providers:
        _providers[key] = make(model) if make else HashProvider(dimensions(model))
    return _providers[key]


def embedded(df: DataFrame, text_col: str, model: str, out: str = "embedding", make: Callable[[str], Provider] | None = None) -> DataFrame:
    """Rows with a non-blank text and their vector in ``out`` (array<float>); blank and null texts are left out first,
    so texts and vectors can't shift against each other."""
    dims = dimensions(model)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = provider(model, make)
        for texts in batches:
            found = own.embed(texts.tolist())
            if len(found) != len(texts) or any(len(v) != dims for v in found):
                raise ValueError("the provider gave a wrong number or size of vectors")
            yield pd.Series(found)

    return df.where(~is_blank(F.col(text_col))).withColumn(out, vectors(F.col(text_col)))


def request_batches(df: DataFrame, id_col: str, tokens_col: str, limit: int = 8_000) -> DataFrame:
    """``id_col``, tokens (capped at the limit), batch: consecutive rows of a partition in requests of at most ``limit`` tokens.

    A batch is ``partition id * 2^33 + number``; the order of rows within a partition is kept.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 33, 0
        for part in batches:
            tokens = part["tokens"].clip(upper=limit)
            numbers = []
            for t in tokens:
                if held and held + t > limit:
                    number, held = number + 1, 0
                held += t
                numbers.append(number)
            yield pd.DataFrame({"id": part["id"], "tokens": tokens, "batch": numbers})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("tokens"))
    return rows.mapInPandas(pack, "id long, tokens long, batch long").withColumnRenamed("id", id_col)
