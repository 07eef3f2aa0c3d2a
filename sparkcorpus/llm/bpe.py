"""Byte-level BPE as a deterministic automaton over tokens.

The merges are compiled one after another. The automaton starts as one state with an arc for every byte. Merging
u and v into w (a merge gadget) gives every state with an arc u an arc w to where v leads, and sends all arcs u to a
copy of their target that lacks the arc v; so all arcs of a token lead to one state and each merge adds one state. A
state is stored as its difference from the state it copies. The accepted paths are exactly the encodings, so a word
has one path and each of its prefixes at most one: it is found left to right by table lookups, without trying merges.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import partial

import regex
from pyspark import SparkFiles
from pyspark.sql import SparkSession

DEFAULT_DIR = "/opt/tokenizers"
#: Fixed value: how the public tokenizer splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 200_000


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    """Compiled merges; ``encode_word`` reads bytes, ``decode`` emits the labels of arcs."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = vocab
        self.labels = {i: b for b, i in vocab.items()}
        size = max(self.labels) + 1
        self.left, self.made, self.target = [-1] * size, [-1] * size, [0] * size
        self.parent, self.lacks, self.born = [-1], [-1], [-1]
        for at, (u, v) in enumerate(merges):
            self._gadget(at, vocab[u], vocab[v], vocab[u + v])
        # every prefix of a token, with the token's id where the prefix is one
        self.prefixes: dict[bytes, int] = {}
        for token, i in vocab.items():
            for n in range(1, len(token)):
                self.prefixes.setdefault(token[:n], -1)
            self.prefixes[token] = i
        self.arcs: dict[int, bool] = {}
        self.size = size

    def _gadget(self, at: int, u: int, v: int, w: int) -> None:
        self.left[w], self.made[w] = u, at
        self.target[w] = self.target[v]
        self.parent.append(self.target[u])
        self.lacks.append(v)
        self.born.append(at)
        self.target[u] = len(self.parent) - 1

    def arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc of the token: later tokens follow their left part, older ones the copied state."""
        key = state * self.size + token
        known = self.arcs.get(key)
        if known is None:
            s, t, known = state, token, True
            while s:
                if self.made[t] >= self.born[s]:
                    t = self.left[t]
                elif t == self.lacks[s]:
                    known = False
                    break
                else:
                    s = self.parent[s]
            if len(self.arcs) > 4_000_000:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        n, prefixes, target, arc = len(word), self.prefixes, self.target, self.arc
        last, frm = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            if i and last[i] < 0:
                continue
            state = target[last[i]] if i else 0
            for j in range(i + 1, n + 1):
                token = prefixes.get(word[i:j])
                if token is None:
                    break
                if token >= 0 and last[j] < 0 and arc(state, token):
                    last[j], frm[j] = token, i
        out, j = [], n
        while j:
            out.append(last[j])
            j = frm[j]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.labels[i] for i in ids)


class Tokenizer:
    """Splits a text into words and encodes each; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        tokens = {a + b for a, b in merges}
        vocab = {t: i for s, i in model["vocab"].items() if all(c in letters for c in s) and (len(t := raw(s)) == 1 or t in tokens)}
        self.automaton = MergeAutomaton(vocab, merges)
        self.words = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty text and a null text both give an empty list. A lone surrogate counts as U+FFFD."""
        out: list[int] = []
        for word in self.words.findall(text or ""):
            ids = self.known.get(word)
            if ids is None:
                ids = self.automaton.encode_word(word.encode("utf-8", "replace"))
                if len(word) <= 64:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


_loaded: dict[str, Tokenizer] = {}


def tokenizer(name: str = "byte_bpe_50k", folder: str = DEFAULT_DIR) -> Tokenizer:
    """The process's compiled tokenizer of a vocabulary file, made once."""
    path = os.path.join(folder, f"{name}.json")
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def shipped(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = DEFAULT_DIR) -> Callable[[], Tokenizer]:
    """The tokenizer for use in tasks: only the driver reads ``folder``, and Spark brings the file to each executor once."""
    path = os.path.join(folder, f"{name}.json")
    if path not in _sent.setdefault(spark.sparkContext.applicationId, set()):
        spark.sparkContext.addFile(path)
        _sent[spark.sparkContext.applicationId].add(path)
    return partial(_in_task, name)


_sent: dict[str, set[str]] = {}


def _in_task(name: str) -> Tokenizer:
    return tokenizer(name, SparkFiles.getRootDirectory())
