"""Embedding providers: local models behind ONNX sessions, remote services over HTTP, and the choice between them."""

from __future__ import annotations

import json
import os
import random
import string
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from functools import partial
from typing import Any

import numpy as np

from sparkcorpus.functions.text import PREFIXES
from sparkcorpus.functions.tokens import MakeEncoder, truncated
from sparkcorpus.operators.embedding import HashProvider, Provider, RetryingProvider, WindowLimiter, dimensions

#: The prefix family of each local model, how it pools, and the tokens a server takes of it.
FAMILIES = {"intfloat/multilingual-e5-small": "e5", "intfloat/multilingual-e5-large": "e5", "jinaai/jina-embeddings-v5-text-small": "jina", "jinaai/jina-embeddings-v5-text-nano": "jina"}
TOKEN_LIMITS = {"intfloat/multilingual-e5-large": 500, "jinaai/jina-embeddings-v5-text-small": 30_000}


def family(model: str) -> str:
    return FAMILIES.get(model, "plain")


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def mean_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the hidden states (text, token, dimension) over the tokens that are no padding."""
    weights = mask.astype(hidden.dtype)[:, :, None]
    return (hidden * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-9)


def last_token_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Hidden state of the last token that is no padding, on whichever side the padding stands."""
    last = mask.shape[1] - 1 - np.argmax(mask[:, ::-1] > 0, axis=1)
    return hidden[np.arange(len(hidden)), last]


class SessionProvider:
    """A model behind a session with ``run(None, feeds)``, as ONNX Runtime has it; unit vectors.

    ``tokenize`` gives input_ids and attention_mask (text, token) of a list of texts.
    """

    def __init__(self, session: Any, tokenize: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], pool: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.session, self.tokenize, self.pool = session, tokenize, pool

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        ids, mask = self.tokenize(texts)
        feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        wanted = {i.name for i in self.session.get_inputs()}
        hidden = self.session.run(None, {k: v for k, v in feeds.items() if k in wanted})[0]
        return unit(self.pool(np.asarray(hidden, np.float64), mask)).tolist()


def local_provider(model: str, folder: str, threads: int = 1, most: int = 512) -> Provider:
    """A model from ``<folder>/<model>/model.onnx`` and ``tokenizer.json``: mean pooling, or the last token for the jina family."""
    import onnxruntime
    from tokenizers import Tokenizer

    path = os.path.join(folder, model)
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    tokenizer = Tokenizer.from_file(os.path.join(path, "tokenizer.json"))
    tokenizer.enable_truncation(most)
    tokenizer.enable_padding()

    def tokenize(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = tokenizer.encode_batch(texts)
        return np.array([e.ids for e in found], np.int64), np.array([e.attention_mask for e in found], np.int64)

    return SessionProvider(onnxruntime.InferenceSession(os.path.join(path, "model.onnx"), options), tokenize, last_token_pooled if family(model) == "jina" else mean_pooled)


def _post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:  # noqa: S310
        return answer.read()


class HttpProvider:
    """A service that answers ``{"model", "input"}`` with ``{"data": [{"index", "embedding"}]}``.

    Overload (429) and server errors count as lost connections, which ``RetryingProvider`` tries again; what the service
    refuses otherwise is an error at once.
    """

    def __init__(self, url: str, model: str, key: str | None = None, timeout: float = 120.0, post: Callable[[str, bytes, dict[str, str], float], bytes] = _post):
        self.url, self.model, self.key, self.timeout, self.post = url, model, key, timeout, post

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            answer = self.post(self.url, json.dumps({"model": self.model, "input": texts}).encode(), headers, self.timeout)
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise ConnectionError(f"the service answered {e.code}") from e
            raise ValueError(f"the service refused the request: {e.code}") from e
        data = sorted(json.loads(answer)["data"], key=lambda d: d["index"])
        if [d["index"] for d in data] != list(range(len(texts))):
            raise ValueError("the service left out vectors")
        return [d["embedding"] for d in data]


class PreparedProvider:
    """Another provider that is given each text with the prefix of its kind, cut to ``most`` tokens."""

    def __init__(self, inner: Provider, kind: str = "passage", of: str = "plain", most: int | None = None, encoder: MakeEncoder | None = None):
        self.inner, self.prefix = inner, PREFIXES[of][0 if kind == "query" else 1]
        self.most, self.encoder = most, encoder

    def embed(self, texts: list[str]) -> list[list[float]]:
        texts = [self.prefix + t for t in texts]
        if self.most and self.encoder:
            encoder = self.encoder()
            texts = [truncated(encoder, t, self.most) for t in texts]
        return self.inner.embed(texts)


def shared_limit(workers: int, requests: int = 9_000, tokens: int = 40_000_000, seconds: float = 60.0) -> WindowLimiter:
    """One worker's part of a limit that all workers keep together."""
    return WindowLimiter(max(1, requests // workers), max(1, tokens // workers), seconds)


def make_provider(model: str, kind: str = "passage", remote: str | None = None, key: str | None = None, folder: str | None = None, encoder: MakeEncoder | None = None, workers: int = 1) -> Provider:
    """The provider of a model: the hashing one for the mock model, the service at ``remote`` where one is named, else
    the model in ``folder``. A hosted model needs a service; every known model gets its prefixes and its token limit."""
    of = family(model)
    if model == "mock_model":
        return HashProvider(dimensions(model))
    if remote:
        service = HttpProvider(remote, model, key)
        return PreparedProvider(RetryingProvider(service, limiter=shared_limit(workers)), kind, of, TOKEN_LIMITS.get(model, 8_000), encoder)
    if of == "plain":
        dimensions(model)
        raise ValueError(f"{model} needs a service")
    if folder is None:
        raise ValueError(f"{model} needs a folder with its files, or a service")
    return PreparedProvider(local_provider(model, folder), kind, of)


def routed(kind: str = "passage", **settings) -> Callable[[str], Provider]:
    """``make_provider`` with settings, for use in ``embedded``, a store or an engine."""
    return partial(make_provider, kind=kind, **settings)


def benchmark(model: str, num_texts: int = 50, text_length: int = 200, make: Callable[[str], Provider] | None = None, seed: int | None = None, clock: Callable[[], float] = time.perf_counter) -> dict:
    """How fast a provider embeds random texts of ``text_length // 5`` words of three to ten letters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 10)))
    texts = [" ".join(word() for _ in range(text_length // 5)) for _ in range(num_texts)]
    own = make(model) if make else HashProvider(dimensions(model))
    start = clock()
    vectors = own.embed(texts)
    seconds = max(clock() - start, 1e-9)
    return {
        "num_texts": num_texts, "avg_text_length": text_length, "total_time_seconds": round(seconds, 3), "texts_per_second": round(num_texts / seconds, 2),
        "ms_per_text": round(seconds / num_texts * 1000, 2) if num_texts else 0.0, "embedding_dimension": len(vectors[0]) if vectors else 0,
    }
