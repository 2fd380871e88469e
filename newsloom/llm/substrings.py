"""Substring dedup: repeated windows of 35 words are removed wherever they stand.

Method: Rabin-Karp hashes of every window, counted over all documents in Spark; the repeated windows of a document
merge into maximal intervals, and the words inside are removed.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, Rolling, WordHash, distinct, mix64, slices, text_key, window_starts
from .recurrence import ENTRY_SCHEMA, bucket_count, entry_rows, recurring, total_chars

WINDOW = 35
CHUNK_CHARS = 3_000_000
SPAN_SCHEMA = "_id long, _th long, starts binary"


def _entries(width: int, buckets: int):
    def run(batches):
        task, words, n = TaskContext.get().partitionId(), WordHash(), 0
        first, second = Rolling(width, BASES[0]), Rolling(width, BASES[1])
        for batch in batches:
            ids, keys, texts = (batch[c].to_pylist() for c in ("_id", "_th", "text"))
            for a, b in slices(texts, CHUNK_CHARS):
                split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts[a:b]]
                lengths = np.array([len(s) for s in split], np.int64)
                keep = lengths >= width
                if not keep.any():
                    continue
                h = np.concatenate([words.of(s) for s, k in zip(split, keep) if k])
                at = np.flatnonzero(window_starts(lengths[keep], width))
                e = mix64(first(h)[at])
                _, where, back, count = np.unique(e, return_index=True, return_inverse=True, return_counts=True)
                local = at[count[back] > 1]  # repeated inside the chunk: settled here
                once = np.sort(where)
                spread = mix64(second(mix64(h))[at[once]])
                head = pickle.dumps(([i for i, k in zip(ids[a:b], keep) if k], [i for i, k in zip(keys[a:b], keep) if k],
                                     lengths[keep], local))
                yield entry_rows(f"{task}-{n}", head, e[once], spread, at[once], buckets)
                n += 1
    return run


def _finish(head: bytes, places: np.ndarray) -> pa.Table:
    ids, keys, lengths, local = pickle.loads(head)
    hit = distinct(np.concatenate([places, local]))
    ends = np.cumsum(lengths)
    begins = ends - lengths
    doc = np.searchsorted(ends, hit, side="right")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]]) if len(doc) else [0]
    rows = [(int(doc[s]), (hit[s:e] - begins[doc[s]]).astype(np.int32).tobytes()) for s, e in zip(cuts[:-1], cuts[1:])]
    return pa.table({"_id": pa.array([ids[d] for d, _ in rows], pa.int64()), "_th": pa.array([keys[d] for d, _ in rows], pa.int64()),
                     "starts": pa.array([s for _, s in rows], pa.binary())})


def removal_intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Ascending window starts → maximal intervals [from, to) of covered words."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > width) + 1
    return [(int(s[0]), int(s[-1]) + width) for s in np.split(starts, gaps)]


def repeated_starts(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(_id, _th, starts): int32 starts of the windows of a document that also start anywhere else.

    Documents without such a window have no row. ``docs`` must give the same rows in the same order whenever it is
    read (a table or a staged result), as chunks are named by their place in it. Runs one job to size the buckets.
    """
    buckets = bucket_count(total_chars(docs) // 6)
    rows = docs.select(*text_key(), "text").where(F.length("text") >= 2 * width - 1)
    spans = recurring(rows.mapInArrow(_entries(width, buckets), ENTRY_SCHEMA), _finish, SPAN_SCHEMA)
    return spans.groupBy("_id", "_th").agg(F.first("starts").alias("starts"))


def _packed(batches):
    """Texts compressed for the shuffle that brings them to their windows."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [pack.compress(t.encode("utf-8", "surrogatepass")) if t else None for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["_id"], batch["_th"], pa.array(texts, pa.binary())], names=["_id", "_th", "packed"])


def dedup_substrings(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, intervals (array of from, to).

    ``docs`` has doc_id (integer) and text; other columns are ignored, whatever their names. Null and empty texts have no words. Texts
    shorter than ``width`` words keep all of them. Repeated rows are repeats of each other: both lose their windows.
    Rows with a null doc_id are judged like others. An empty table gives an empty result.
    """
    marks = repeated_starts(docs, width)
    rows = docs.select(*text_key(), "text").mapInArrow(_packed, "_id long, _th long, packed binary").alias("d")
    joined = rows.join(marks.alias("m"), F.col("d._id").eqNullSafe(F.col("m._id")) & (F.col("d._th") == F.col("m._th")), "left").select(
        F.col("d._id").alias("doc_id"), F.col("d.packed").alias("packed"), F.col("m.starts").alias("starts"))

    def cut(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for i, t, s in zip(*(batch[c].to_pylist() for c in ("doc_id", "packed", "starts"))):
                words = unpack.decompress(t).split() if t else []
                spans = removal_intervals(np.frombuffer(s, np.int32), width) if s else []
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                text = b" ".join(kept)
                out.append((i, len(words), len(words) - len(kept), text.decode("utf-8", "replace"), hashlib.sha256(text).hexdigest(), spans))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()),
                pa.array(cols[4], pa.string()),
                pa.array([[{"start": a, "stop": b} for a, b in s] for s in cols[5]], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "intervals"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, "
                                  "intervals array<struct<start:int,stop:int>>")
