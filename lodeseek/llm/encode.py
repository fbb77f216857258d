"""Encoding with a public byte-level BPE tokenizer by prefix-sharing trie traversal.

The encoding of a text's first i bytes is the encoding of its first i - len(t) bytes followed by t, where t, the last token,
is the only token that ends there and may follow what ends before it. So one number per prefix, its last token, describes
all encodings. The distinct words of a batch are visited in sorted order, which is the depth-first order of their trie;
a stack holds the last tokens of the current path, and prefixes shared with the previous word are not computed again.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How byte_bpe_50k cuts a text into words (fixed value of the public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers between batches; beyond, it starts afresh.
REMEMBERED = 400_000


class TrieEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.parts: dict[int, tuple[int, int]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self._valid: dict[tuple[int, int], bool] = {}
        # lengths of the tokens by their last two bytes, longest first
        lengths: dict[bytes, set[int]] = {}
        for i in sorted(self.token):
            b = self.token[i]
            if len(b) > 1:
                made = self._halves(b, i)
                if made is None:  # no merge leads to it, so it never comes out
                    continue
                self.parts[i] = made
            if len(b) > 1:
                lengths.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}

    def _halves(self, b: bytes, i: int) -> tuple[int, int] | None:
        for n in range(1, len(b)):
            left, right = self.ranks.get(b[:n]), self.ranks.get(b[n:])
            if left is not None and right is not None and left < i and right < i and self.may_follow(left, right, i):
                return left, right
        return None

    def may_follow(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether left, right stay two tokens when their bytes are encoded together (up to merges of rank limit).

        Undo the merges that made the two, the latest first, and look at each step whether the pieces that touched
        would have been merged across before the next inner merge took place. Of equal ranks the left one goes first.
        """
        known = self._valid.get((left, right)) if limit is None else None
        if known is not None:
            return known
        a, b, before = left, right, limit if limit is not None else 1 << 60
        good = True
        while True:
            across = self.ranks.get(self.token[a] + self.token[b])
            if across is not None and across < before:
                good = False
                break
            inner_a, inner_b = self.parts.get(a), self.parts.get(b)
            if inner_a is None and inner_b is None:
                break
            if inner_b is None or inner_a is not None and a > b:
                before, a = min(before, a), inner_a[1]
            else:
                before, b = min(before, b + 1), inner_b[0]
        if limit is None:
            if len(self._valid) > 2_000_000:
                self._valid.clear()
            self._valid[left, right] = good
        return good

    def _extend(self, word: bytes, last: list[int]) -> None:
        """Append the last token of each further prefix of word to last (last[i] belongs to i bytes)."""
        ranks, parts = self.ranks, self.parts
        for i in range(len(last), len(word) + 1):
            found = -1
            for n in self.lengths.get(word[max(i - 2, 0) : i], ()):
                if n <= i and (t := ranks.get(word[i - n : i])) is not None and t in parts and (n == i or self.may_follow(last[i - n], t)):
                    found = t
                    break
            last.append(found if found >= 0 else ranks[word[i - 1 : i]])

    def learn(self, words: set[str]) -> None:
        """Encode words into the memory."""
        last, path = [-1], b""
        for word in sorted(w.encode("utf-8", "surrogatepass") for w in words):
            del last[len(commonprefix((path, word))) + 1 :]
            self._extend(word, last)
            path = word
            ids, i = [], len(word)
            while i:
                ids.append(last[i])
                i -= len(self.token[last[i]])
            self.words[word.decode("utf-8", "surrogatepass")] = tuple(ids[::-1])

    def encode_batch(self, texts: list[str | None]) -> list[list[tuple[int, ...]]]:
        """For each text the ids of its words; null and empty texts have none."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        cut = [self.split(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)) - self.words.keys())
        words = self.words
        return [[words[w] for w in c] for c in cut]


@lru_cache(maxsize=2)
def _encoder(file: bytes) -> TrieEncoder:
    return TrieEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())})


@lru_cache(maxsize=2)
def vocabulary_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(path: str) -> TrieEncoder:
    """One encoder a process and vocabulary."""
    return _encoder(vocabulary_file(path))


def _shipped(df: DataFrame, path: str):
    """The vocabulary file as a broadcast: the driver reads it, so no worker needs the path. A public vocabulary has a few megabytes at most."""
    return df.sparkSession.sparkContext.broadcast(vocabulary_file(path))


def _kind(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>) for every row, in place: no shuffle. Null and empty texts have an empty list."""

    shared = _shipped(df, vocabulary)

    def run(batches):
        e = _encoder(shared.value)
        for b in batches:
            coded = e.encode_batch(b[text].to_pylist())
            ids = [np.fromiter(chain.from_iterable(c), dtype=np.int32) for c in coded]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([b[key], pa.ListArray.from_arrays(pa.array(offsets), flat)], [key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {_kind(df, key)}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of keep plus tokens LONG."""

    shared = _shipped(df, vocabulary)

    def run(batches):
        e = _encoder(shared.value)
        for b in batches:
            n = [sum(map(len, c)) for c in e.encode_batch(b[text].to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(n, pa.int64())], [*keep, "tokens"])

    return df.select(*keep, text).mapInArrow(run, ", ".join(f"`{c}` {_kind(df, c)}" for c in keep) + ", tokens long")
