"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What identifies a row for a decision made from its text: the id (null allowed) and a hash of the text."""
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_th")]


def kept_rows(docs: DataFrame, decisions: DataFrame, keep: str) -> DataFrame:
    """Rows of ``docs`` whose decision (keyed by ``_id``, ``_th``) has ``keep``; columns as in ``docs``.

    Equal rows share one decision, so a table with repeated rows keeps or loses all of them together.
    """
    good = decisions.where(F.col(keep)).groupBy("_id", "_th").agg(F.lit(True).alias("_keep"))
    mark = good.select(F.col("_id").alias("_i2"), F.col("_th").alias("_t2"))
    on = F.col("doc_id").eqNullSafe(F.col("_i2")) & (F.xxhash64(F.col("text")) == F.col("_t2"))
    return docs.join(mark, on, "left_semi")


def slices(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """(from, to) over a list of strings or None, each slice within ``limit`` characters or one single text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixer for uint64 arrays (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for millions of values several times faster than a hash table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class WordHash(dict):
    """word bytes → 64-bit hash, remembered for a bounded number of words."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93 | 1))


class Rolling:
    """Rabin-Karp hashes, modulo 2^64, of all windows of ``width`` word hashes."""

    def __init__(self, width: int, base: np.uint64):
        self.width, self.base = width, base
        self.inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            steps = np.full(n, self.base, np.uint64)
            steps[0] = 1
            back = np.full(n, self.inverse, np.uint64)
            back[0] = 1
            self.up, self.down = np.cumprod(steps), np.cumprod(back)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        """One hash for each start; empty when there are fewer words than the width."""
        n = len(words)
        if n < self.width:
            return np.zeros(0, np.uint64)
        self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.up[:n], out=sums[1:])
        return (sums[self.width:] - sums[:-self.width]) * self.down[:n - self.width + 1]


def window_starts(lengths: np.ndarray, width: int) -> np.ndarray:
    """Boolean over the starts 0 … total − width: does the window lie inside one document?"""
    total = int(lengths.sum())
    if total < width:
        return np.zeros(0, bool)
    ends = np.repeat(np.cumsum(lengths), lengths)
    return np.arange(total - width + 1) + width <= ends[:total - width + 1]
