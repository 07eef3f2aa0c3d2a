import http.server
import json
import threading
import urllib.error

import numpy as np
import pytest

from sparkcorpus.engine import Engine
from sparkcorpus.functions import tokens
from sparkcorpus.operators import providers as p
from sparkcorpus.operators.embedding import HashProvider
from sparkcorpus.sources.http import Fetcher
from sparkcorpus.sources.sitemap import TooManyRequests

HIDDEN = np.array([[[1.0, 0], [3, 4], [9, 9]], [[0, 2], [9, 9], [9, 9]]])
MASK = np.array([[1, 1, 0], [1, 0, 0]])


def test_pooling():
    assert p.mean_pooled(HIDDEN, MASK).tolist() == [[2, 2], [0, 2]]
    assert p.last_token_pooled(HIDDEN, MASK).tolist() == [[3, 4], [0, 2]]
    assert p.last_token_pooled(HIDDEN, MASK[:, ::-1]).tolist() == [[9, 9], [9, 9]]
    assert p.mean_pooled(HIDDEN, np.zeros_like(MASK)).tolist() == [[0, 0], [0, 0]]
    assert p.unit(np.array([[3.0, 4], [0, 0]])).tolist() == [[0.6, 0.8], [0, 0]]


class Session:
    def get_inputs(self):
        return [type("Input", (), {"name": n}) for n in ("input_ids", "attention_mask")]

    def run(self, _, feeds):
        assert set(feeds) == {"input_ids", "attention_mask"}
        return [HIDDEN[: len(feeds["input_ids"])]]


def test_sessions():
    tokenize = lambda texts: (np.ones((len(texts), 3), np.int64), MASK[: len(texts)])
    assert np.allclose(p.SessionProvider(Session(), tokenize, p.last_token_pooled).embed(["a", "b"]), [[0.6, 0.8], [0, 1]])
    assert p.SessionProvider(Session(), tokenize, p.mean_pooled).embed([]) == []


def test_services():
    seen = []

    def post(url, body, headers, timeout):
        seen.append((json.loads(body), headers))
        return json.dumps({"data": [{"index": i, "embedding": [float(i)]} for i in (1, 0)]}).encode()

    service = p.HttpProvider("http://x", "m", "k", post=post)
    assert service.embed(["a", "b"]) == [[0.0], [1.0]] and service.embed([]) == []
    assert seen == [({"model": "m", "input": ["a", "b"]}, {"Content-Type": "application/json", "Authorization": "Bearer k"})]
    with pytest.raises(ValueError, match="left out"):
        service.embed(["a", "b", "c"])

    def refusing(code):
        def post(*_):
            raise urllib.error.HTTPError("http://x", code, "no", {}, None)

        return p.HttpProvider("http://x", "m", post=post)

    for code, kind in ((429, ConnectionError), (503, ConnectionError), (400, ValueError)):
        with pytest.raises(kind):
            refusing(code).embed(["a"])


class Letters:
    def encode(self, text):
        return [ord(c) for c in text]

    def decode(self, ids):
        return "".join(map(chr, ids))


def letters():
    return Letters()


def test_prefixes_limits_and_routes():
    class Echo:
        def embed(self, texts):
            return texts

    assert p.PreparedProvider(Echo(), "query", "e5").embed(["a"]) == ["query: a"] and p.PreparedProvider(Echo(), "passage", "jina").embed(["a"]) == ["Document: a"]
    assert p.PreparedProvider(Echo(), "passage", "plain", 3, letters).embed(["abcdef", "ab"]) == ["abc", "ab"]
    assert isinstance(p.make_provider("mock_model"), HashProvider)
    remote = p.make_provider("intfloat/multilingual-e5-large", remote="http://x")
    assert remote.prefix == "passage: " and remote.most == 500 and remote.inner.inner.url == "http://x"
    assert p.make_provider("text-embedding-3-small", remote="http://x", workers=10).inner.limiter.requests == 900
    for model in ("text-embedding-3-small", "intfloat/multilingual-e5-small", "none"):
        with pytest.raises(ValueError):
            p.make_provider(model)


def test_benchmark(spark):
    now = iter([1.0, 3.0])
    got = p.benchmark("mock_model", 4, 50, clock=lambda: next(now))
    assert got == {"num_texts": 4, "avg_text_length": 50, "total_time_seconds": 2.0, "texts_per_second": 2.0, "ms_per_text": 500.0, "embedding_dimension": 4}
    assert Engine(spark, None, None).benchmark_embeddings("mock_model", 3, 20)["embedding_dimension"] == 4
    assert p.benchmark("mock_model", 0)["embedding_dimension"] == 0


def test_tokens(spark):
    assert tokens.windows(Letters(), "abcdefghij", 4, 1) == ["abcd", "defg", "ghij"] and tokens.windows(Letters(), "abcdefghijk", 4, 1)[-1] == "jk"
    assert tokens.windows(Letters(), "abc", 4, 1) == ["abc"] and tokens.windows(Letters(), "", 4, 1) == []
    df = spark.createDataFrame([("abcdefg",), (None,), ("",)], "t string")
    t = df["t"]
    got = df.select(tokens.token_count(t, letters), tokens.token_count(t), tokens.token_windows(t, 4, 0, letters), tokens.truncate_tokens(t, 2, letters)).collect()
    assert [tuple(r) for r in got] == [(7, 1, ["abcd", "efg"], "ab"), (0, 0, [], None), (0, 0, [], "")]
    with pytest.raises(ValueError):
        tokens.token_windows(t, 4, 4, letters)


def test_fetcher():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            code = int(self.path[1:4])
            self.send_response(code)
            self.send_header("Content-Type", "text/plain; charset=latin-1")
            self.end_headers()
            self.wfile.write("æ".encode("latin-1"))

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, fetch = f"http://127.0.0.1:{server.server_port}/", Fetcher(5)
    try:
        assert fetch(base + "200") == "æ"
        for code, kind in ((429, TooManyRequests), (500, ConnectionError), (404, ValueError)):
            with pytest.raises(kind):
                fetch(base + str(code))
        with pytest.raises(ValueError):
            fetch("file:///etc/hosts")
    finally:
        server.shutdown()
