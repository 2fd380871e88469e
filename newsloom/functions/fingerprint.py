"""64-bit SimHash over word tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

TOKEN = "[0-9A-Za-zА-Яа-яЁё]{3,}"
LANES = 0x0000000100000001
#: CP1251 has every letter of a token as one byte; all other bytes separate
TOKEN_BYTES = bytes(i if re.fullmatch(TOKEN, bytes([i]).decode("cp1251", "replace") * 3) else 32 for i in range(256))
#: texts worked on at once, tokens remembered in a Python worker, tokens of one text summed at once
SLICE_BYTES, TOKENS_KEPT, PIECE = 2_000_000, 200_000, 100_000


def _low64(token: Column) -> Column:
    """Low 64 bits of the MD5 of a token, as a signed long."""
    digest = F.md5(token)
    high = F.conv(F.substring(digest, 17, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 25, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def _pair_count(hashes: Column, i: int) -> Column:
    def add(total: Column, h: Column) -> Column:
        return total + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES))

    return F.aggregate(hashes, F.lit(0).cast("long"), add)


def _pair_bits(n: Column, i: int):
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def bits(pair: Column) -> Column:
        low = F.when(pair.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 >= n, F.shiftleft(one, i)).otherwise(zero)
        high = F.when(F.shiftrightunsigned(pair, 32) * 2 >= n, F.shiftleft(one, i + 32)).otherwise(zero)
        return low.bitwiseOR(high)

    return bits


def simhash64_expr(text: Column) -> Column:
    """SimHash of one text as a column expression: no explode, no shuffle, no Python.

    Every bit is set when at least half of the token occurrences have it. The occurrences are counted for
    bits i and i+32 at once, as the two 32-bit halves of one long. A text without tokens gives 0.

    Interpreted lambdas make it about ten times slower than ``simhash64`` on article-length texts; use it
    for short strings, or where no Python workers are wanted.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    hashes = F.transform(tokens, _low64)

    def fold(h: Column) -> Column:
        n = F.size(h).cast("long")
        out = F.lit(0).cast("long")
        for i in range(32):
            # one-element transform: the pair of counts is evaluated once for both bits
            out = out.bitwiseOR(F.transform(F.array(_pair_count(h, i)), _pair_bits(n, i))[0])
        return F.when(n == 0, F.lit(0).cast("long")).otherwise(out)

    # one-element transform: evaluates the hashes once and hands them to the fold
    return F.transform(F.array(hashes), fold)[0]


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


class TokenDigests(dict):
    """token in CP1251 → its place among the low 64 bits of the MD5 digests, -1 for a run that is too short to be one."""

    def __init__(self):
        self.digests = bytearray()

    def __missing__(self, token: bytes) -> int:
        if len(token) < 3:
            return -1
        n = self[token] = len(self)
        self.digests += hashlib.md5(token.decode("cp1251").encode("utf-8")).digest()[8:]  # noqa: S324
        return n

    def of(self, runs: list) -> tuple[np.ndarray, np.ndarray]:
        """(is the run a token?, one row of 8 bytes for each token)."""
        if len(self) > TOKENS_KEPT:
            self.clear()
            self.digests = bytearray()
        at = np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))
        return at >= 0, np.frombuffer(bytes(self.digests), np.uint8).reshape(-1, 8)[at[at >= 0]]


def _fingerprint(rows: np.ndarray) -> int:
    ones = sum(np.unpackbits(rows[a:a + PIECE], axis=1).sum(0, dtype=np.int64) for a in range(0, len(rows), PIECE))
    return int.from_bytes(np.packbits(2 * ones >= len(rows)).tobytes(), "big", signed=True)


@F.arrow_udf(LongType())
def simhash64(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """SimHash of each text, NULL for NULL or blank ones; tokens are hashed once while they are remembered.

    Whitespace does not matter, so the text need not be normalised first. A batch is worked on in slices of bounded size.
    """
    known = TokenDigests()
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(size // SLICE_BYTES, prepend=0, append=-1))
        out, begin = [], 0
        for end in np.unique(np.append(cuts, len(batch))).tolist():
            texts = batch.slice(begin, end - begin).to_pylist()
            begin = end
            # one byte for each letter of a token, whatever else is there becomes a separator
            runs = [(x or "").lower().encode("cp1251", "replace").translate(TOKEN_BYTES).split() for x in texts]
            lengths = np.cumsum([0, *map(len, runs)])
            used, rows = known.of([r for run in runs for r in run])
            ends = np.concatenate([[0], np.cumsum(used)])[lengths]
            for x, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist()):
                out.append(None if not (x or "").strip() else _fingerprint(rows[a:b]) if b > a else 0)
        yield pa.array(out, pa.int64())
