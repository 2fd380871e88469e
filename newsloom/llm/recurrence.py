"""Which hashes occur more than once over a whole table, in bounded memory.

Tasks cut their rows into chunks. A chunk keeps one entry for each distinct hash and packs its entries by
bucket: one row for each (bucket, chunk), 8 bytes for a hash and 1 to 4 for its position, instead of one row for each
occurrence. However often a hash occurs, a chunk sends it once, so a hot hash costs at most one entry per chunk.
Bucket and entry come from two independent hashes; a bucket holds about ``BUCKET_ENTRIES`` entries at any
input size, so two different windows are taken for equal with a probability of BUCKET_ENTRIES / 2^64 each.
Header rows (what a chunk knows by itself) travel in the same shuffle and come back with the answers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_ENTRIES = 500_000
ENTRY_SCHEMA = "bucket int, chunk string, head binary, hashes binary, places binary"
ANSWER_SCHEMA = "chunk string, head binary, places binary"
MEETING_SCHEMA = "chunk string, head binary, places binary, lows binary"


def bucket_count(items: int) -> int:
    return max(64, math.ceil(items / BUCKET_ENTRIES))


def pack_places(p: np.ndarray) -> bytes:
    """Ascending positions as differences, in as few bytes as their largest needs, byte planes apart."""
    if not len(p):
        return b""
    d = np.diff(p, prepend=0)
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def unpack_places(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.int64)
    width = b[0]
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :width] = planes.T
    return np.cumsum(full.view("<u8").ravel().astype(np.int64))


def entry_rows(chunk: str, head: bytes, entry: np.ndarray, spread: np.ndarray, place: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of one chunk; ``entry``, ``spread`` (for the bucket) and ``place`` are parallel, places ascending."""
    b = ((spread >> np.uint64(11)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 65_536 else np.uint32)
    order = np.argsort(b, kind="stable")
    b, entry, place = b[order], entry[order], place[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(b)]])
    if not len(b):
        starts = ends = starts[:0]
    own = int.from_bytes(chunk.encode()[-4:], "little") % buckets
    return pa.RecordBatch.from_arrays([
        pa.array([int(b[s]) for s in starts] + [own], pa.int32()),
        pa.array([chunk] * (len(starts) + 1), pa.string()),
        pa.array([None] * len(starts) + [head], pa.binary()),
        pa.array([entry[s:e].tobytes() for s, e in zip(starts, ends)] + [None], pa.binary()),
        pa.array([pack_places(place[s:e]) for s, e in zip(starts, ends)] + [None], pa.binary()),
    ], names=["bucket", "chunk", "head", "hashes", "places"])


def _answer(group: pa.Table) -> pa.Table:
    chunks, heads = group["chunk"].to_pylist(), group["head"].to_pylist()
    blobs, places = group["hashes"].to_pylist(), group["places"].to_pylist()
    rows = [i for i, x in enumerate(blobs) if x is not None]
    out = [(chunks[i], heads[i], None) for i, x in enumerate(blobs) if x is None]
    if rows:
        parts = [np.frombuffer(blobs[i], np.uint64) for i in rows]
        every = np.concatenate(parts)
        order = np.argsort(every)
        ranked = every[order]
        same = ranked[1:] == ranked[:-1]
        again = np.zeros(len(every), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = 0
        for i, part in zip(rows, parts):
            hit = again[at:at + len(part)]
            at += len(part)
            if hit.any():
                out.append((chunks[i], None, pack_places(unpack_places(places[i])[hit])))
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.string()), "head": pa.array([x[1] for x in out], pa.binary()),
                     "places": pa.array([x[2] for x in out], pa.binary())})


def recurring(entries: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """Entries of all chunks → ``finish(head, places)`` for each chunk, with the ascending places that recur in other chunks.

    ``finish`` returns an Arrow table of ``schema``.
    """
    answers = entries.groupBy("bucket").applyInArrow(_answer, ANSWER_SCHEMA)

    def close(group: pa.Table) -> pa.Table:
        head = next(h for h in group["head"].to_pylist() if h is not None)
        found = [unpack_places(p) for p in group["places"].to_pylist() if p is not None]
        return finish(head, np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64))

    return answers.groupBy("chunk").applyInArrow(close, schema)


def _base(chunk: str) -> int:
    """Number of the first owner of a chunk: owners of all chunks have numbers of their own (up to 2^22 in a chunk, 2^18 chunks in a task)."""
    task, n = map(int, chunk.split("-"))
    return task << 40 | n << 22


def _meeting(group: pa.Table) -> pa.Table:
    chunks, heads = group["chunk"].to_pylist(), group["head"].to_pylist()
    blobs, places = group["hashes"].to_pylist(), group["places"].to_pylist()
    rows = [i for i, x in enumerate(blobs) if x is not None]
    out = [(chunks[i], heads[i], None, None) for i, x in enumerate(blobs) if x is None]
    if rows:
        own = [unpack_places(places[i]) for i in rows]
        every = np.concatenate([np.frombuffer(blobs[i], np.uint64) for i in rows])
        number = np.concatenate([_base(chunks[i]) + p for i, p in zip(rows, own)])
        order = np.lexsort((number, every))
        starts = np.flatnonzero(np.diff(every[order], prepend=~every[order[:1]]))
        count = np.diff(starts, append=len(every))
        low, shared = np.empty(len(every), np.int64), np.empty(len(every), bool)
        low[order], shared[order] = np.repeat(number[order][starts], count), np.repeat(count > 1, count)
        at = 0
        for i, p in zip(rows, own):
            hit = shared[at:at + len(p)]
            if hit.any():
                out.append((chunks[i], None, pack_places(p[hit]), low[at:at + len(p)][hit].tobytes()))
            at += len(p)
    return pa.table({c: pa.array([x[k] for x in out], pa.string() if not k else pa.binary()) for k, c in enumerate(("chunk", "head", "places", "lows"))})


def linking(entries: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """Entries of all chunks, whose places are owners → ``finish(head, base, owners, lows)`` for each chunk.

    An owner of an entry that occurs in other chunks too comes with the lowest number of all owners of that entry, its own if that is the lowest; the
    number of an owner is its place in the chunk added to ``base``. ``finish`` returns an Arrow table of ``schema``.
    """
    met = entries.groupBy("bucket").applyInArrow(_meeting, MEETING_SCHEMA)

    def close(group: pa.Table) -> pa.Table:
        head = next(h for h in group["head"].to_pylist() if h is not None)
        none = np.zeros(0, np.int64)
        owners = [unpack_places(p) for p in group["places"].to_pylist() if p is not None]
        lows = [np.frombuffer(b, np.int64) for b in group["lows"].to_pylist() if b is not None]
        return finish(head, _base(group["chunk"][0].as_py()), np.concatenate([none, *owners]), np.concatenate([none, *lows]))

    return met.groupBy("chunk").applyInArrow(close, schema)


def total_chars(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
