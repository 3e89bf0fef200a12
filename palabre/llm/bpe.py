"""Encoding of texts with a byte-level BPE vocabulary given as a rank file.

A text is split into words by the vocabulary's pattern. A short word is merged in a contiguous rank
array: the boundaries of its parts lie beside the ranks of each pair of neighbours; the smallest rank
is found by a scan, its boundary deleted, and the two neighbouring ranks are refreshed, until no pair
has a rank. A long word is merged in the same order with a heap, so its cost doesn't grow with the
square of its length. Results of words are kept in a cache of bounded size in each worker.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ..session import even

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 60  # larger than any rank
SHORT = 64  # bytes of a word that is scanned
CACHED = 400_000  # words kept by a worker; then it starts anew


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    at = list(range(len(word) + 1))  # boundaries of the parts
    pair = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]  # pair[i]: rank of parts i and i+1 together
    while pair:
        low = min(pair)
        if low == NONE:
            break
        i = pair.index(low)
        del at[i + 1], pair[i]
        if i < len(pair):
            pair[i] = ranks.get(word[at[i] : at[i + 2]], NONE)
        if i:
            pair[i - 1] = ranks.get(word[at[i - 1] : at[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(at, at[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, total = heappop(heap)
        j = after[i] if size[i] else n
        if j >= n or size[i] + size[j] != total:
            continue  # one of the two was merged meanwhile
        size[i], size[j] = total, 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(word[i : k + size[k]])) is not None:
                heappush(heap, (r, i, total + size[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h : i + total])) is not None:
            heappush(heap, (r, h, size[h] + total))
    return [ranks[word[i : i + size[i]]] for i in range(n) if size[i]]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, cached: int = CACHED):
        self.ranks, self.find, self.cached = ranks, regex.compile(pattern).findall, cached
        self.words: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        b = w.encode("utf-8", "replace")
        if (r := self.ranks.get(b)) is not None:
            ids = [r]
        else:
            ids = _merge_short(b, self.ranks) if len(b) <= SHORT else _merge_long(b, self.ranks)
        if len(w) <= SHORT:
            if len(self.words) >= self.cached:
                self.words.clear()
            self.words[w] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        get, word, extend = self.words.get, self.word, out.extend
        for w in self.find(text):
            extend(get(w) or word(w))
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        get, word = self.words.get, self.word
        return sum(len(get(w) or word(w)) for w in self.find(text))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    return Encoder(load_ranks(path), pattern)


def _encoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(path)).encode
        for b in batches:
            ids = pa.array([encode(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], ["id", "ids"])

    return run


def shipped(spark: SparkSession, path: str) -> str:
    """The vocabulary file sent to every executor, once for each context; its name there."""
    sc = spark.sparkContext
    sent = getattr(sc, "_palabre_files", set())
    if path not in sent:
        sc.addFile(path)
        sc._palabre_files = sent | {path}
    return os.path.basename(path)


def _counting(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(SparkFiles.get(path)).count
        for b in batches:
            i = b.schema.get_field_index("text")
            yield b.remove_column(i).append_column("n_tokens", pa.array([count(t) for t in b.column(i).to_pylist()], pa.int64()))

    return run


def encode_corpus(docs: DataFrame, doc_id: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(``doc_id``, ids) of every row. Empty and null texts give an empty array; repeated rows come out
    as often; special tokens don't exist, their strings are ordinary text. Only narrow work, no shuffle."""
    kind = docs.schema[doc_id].dataType.simpleString()
    out = even(docs.select(docs[doc_id].alias("id"), docs[text].alias("text")), "id").mapInArrow(_encoding(shipped(docs.sparkSession, path)), f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", doc_id)


def token_counts(docs: DataFrame, keep: list[str], text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """``keep`` and ``n_tokens`` of every row; an empty or null text has none."""
    slim = docs.select(*[docs[c].alias(c) for c in keep], docs[text].alias("text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return even(slim, keep[0]).mapInArrow(_counting(shipped(docs.sparkSession, path)), f"{kinds}, n_tokens bigint")
