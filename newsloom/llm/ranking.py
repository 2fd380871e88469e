"""Ranked lexical search: the best documents of every item, found by presence masks.

Method: documents are indexed once per block of items, one row for each chunk of documents, with one posting list for each term of the
block. In a chunk the terms' bitmaps give every document the mask of an item's terms it holds; documents of equal mask form a
group, whose score cannot exceed the sum of its terms' largest contributions in the chunk. Groups are evaluated by descending bound, and a
chunk is finished with an item as soon as the next bound is below the score that a document needs to be among the best. That score
starts from the k-th best of the documents of some tasks evaluated first, so most chunks send next to nothing.

A document is a row: rows repeated with one id are ranked as often as they occur, null ids stand behind all others of equal score.
Rows of ``items`` with one id (null included) are one item with the terms of all its texts. Null or empty texts have no terms. An item with
no term, or none that occurs, has no rows. Items of any number are taken in blocks of bounded size; all other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_path, stage
from .common import ASCII_LOWER, ASCII_UPPER, slices

TOP = 50
CHUNK_DOCS = 8192
SLICE_BYTES = 2_000_000
CHUNK_BYTES = 32_000_000
#: (item, term) pairs held by a task at a time
BLOCK_PAIRS = 200_000
#: evaluated first to learn the scores that are needed: one in so many tasks' documents, and at least so many
FIRST_SHARE, FIRST_DOCS = 64, 4 * CHUNK_DOCS

NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEPT = [c >= 0x80 or chr(c).isalnum() for c in range(256)]
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if _KEPT[c] else 32 for c in range(256))

INDEX_SCHEMA = ("task int, doc_ids array<bigint>, lengths binary, n_docs bigint, n_terms bigint, terms array<int>, counts array<int>, "
                "places binary, tfs binary")
FOUND_SCHEMA = "item_no int, doc_id bigint, score bigint"


def _pack(a: np.ndarray) -> bytes:
    """Unsigned values in the narrowest type that holds them; the first byte is its width."""
    top = int(a.max()) if len(a) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text", block_pairs: int = BLOCK_PAIRS) -> tuple[DataFrame, int]:
    """(item_id, terms, block) and the number of blocks; a block holds about ``block_pairs`` terms, or one larger item."""
    folded = F.translate(F.col(text), ASCII_UPPER, ASCII_LOWER)
    pairs = items.select(F.col(item_id).alias("item_id"), F.explode(F.split(folded, NOT_TERM)).alias("term")).where("term <> ''").distinct()
    grouped = stage(pairs.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")), "items")
    total = grouped.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = math.ceil(total / block_pairs)
    return grouped.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))), blocks


def _indexer(shared):
    """Rows (doc_id, text as bytes) → one index row per chunk, over the terms of the broadcast dictionary."""
    def run(batches):
        ids, context = shared.value, TaskContext.get()
        task = context.partitionId() if context else 0
        docs, lengths, found, size = [], [], [], 0

        def row():
            nonlocal docs, lengths, found, size
            key, tf = np.concatenate(found, axis=1)
            # by term, then by document: the order of a posting list
            order = np.argsort(key, kind="stable")
            key, tf = key[order], tf[order]
            terms, counts = np.unique(key >> 32, return_counts=True)
            n = np.concatenate(lengths)
            out = pa.RecordBatch.from_arrays([
                pa.array([task], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([_pack(n)]), pa.array([int((n > 0).sum())], pa.int64()),
                pa.array([int(n.sum())], pa.int64()), pa.array([terms.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([counts.astype(np.int32)], pa.list_(pa.int32())), pa.array([_pack(key & 0xFFFFFFFF)]), pa.array([_pack(tf)]),
            ], names=["task", "doc_ids", "lengths", "n_docs", "n_terms", "terms", "counts", "places", "tfs"])
            docs, lengths, found, size = [], [], [], 0
            return out

        for batch in batches:
            keys, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for a, b in slices(texts, SLICE_BYTES):
                for lo in range(a, b, CHUNK_DOCS):
                    hi = min(lo + CHUNK_DOCS, b)
                    if docs and (len(docs) + hi - lo > CHUNK_DOCS or size > CHUNK_BYTES):
                        yield row()
                    # \0 marks the ends of the texts: inside of them it is a separator and already gone
                    blob = b" \0 ".join((t or b"").translate(FOLD) for t in texts[lo:hi]) + b" \0"
                    words = blob.split()
                    term = np.fromiter(map(ids.get, words, repeat(-1)), np.int64, len(words))
                    ends = np.flatnonzero(term == -2)
                    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
                    hit = term >= 0
                    # one posting for each (document, term), as document and term number in one key
                    once, tf = np.unique((term[hit] << 32) | (doc[hit] + len(docs)), return_counts=True)
                    found.append(np.stack([once, tf]))
                    lengths.append(np.diff(ends, prepend=-1) - 1)
                    docs += keys[lo:hi]
                    size += len(blob)
        if docs:
            yield row()
    return run


class Best:
    """The best documents of one item so far, and the score a further one needs."""

    def __init__(self, top: int, needed: int):
        self.top, self.needed = top, max(needed, 1)
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = scores >= self.needed
        if not good.any():
            return
        s, i, z = (np.concatenate(p) for p in ((self.scores, scores[good]), (self.ids, ids[good]), (self.null, null[good])))
        order = np.lexsort((i, z, -s))[:self.top]
        self.scores, self.ids, self.null = s[order], i[order], z[order]
        if len(order) == self.top:
            self.needed = max(self.needed, int(self.scores[-1]))


class Chunk:
    """Posting lists, bitmaps and largest contributions of one or more index rows, as one run of documents."""

    def __init__(self, rows: list[dict], weights: np.ndarray, n_docs: int, n_terms: int):
        ids = [x for r in rows for x in r["doc_ids"]]
        self.null = np.array([x is None for x in ids], bool)
        self.ids = np.array([0 if x is None else x for x in ids], np.int64)
        self.size = len(ids)
        n = np.concatenate([_unpack(r["lengths"]) for r in rows])
        m = 50 + (50 * n * n_docs) // n_terms
        starts = np.cumsum([0] + [len(r["doc_ids"]) for r in rows[:-1]])
        term = np.concatenate([np.repeat(np.array(r["terms"], np.int64), np.array(r["counts"], np.int64)) for r in rows])
        place = np.concatenate([_unpack(r["places"]) + s for r, s in zip(rows, starts)])
        tf = np.concatenate([_unpack(r["tfs"]) for r in rows])
        if len(rows) > 1:
            order = np.argsort(term, kind="stable")
            term, place, tf = term[order], place[order], tf[order]
        self.terms, first = np.unique(term, return_index=True)
        self.gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[place]))
        self.most = np.maximum.reduceat(self.gain, first) if len(first) else self.gain
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term))))
        self.key = row * self.size + place
        self.bitmaps = np.zeros((len(first), (self.size + 7) // 8), np.uint8)
        step = max(1, 8_000_000 // max(self.size, 1))
        for lo in range(0, len(first), step):
            a, b = np.searchsorted(row, [lo, lo + step])
            bits = np.zeros((min(step, len(first) - lo), self.size), bool)
            bits[row[a:b] - lo, place[a:b]] = True
            self.bitmaps[lo:lo + step] = np.packbits(bits, axis=1)

    def search(self, terms: np.ndarray, best: Best) -> None:
        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)] if len(self.terms) else at[:0]
        if not len(at) or int(self.most[at].sum()) < best.needed:
            return
        bits = np.unpackbits(self.bitmaps[at], axis=1, count=self.size)
        masks = np.packbits(bits, axis=0)
        wide = np.zeros((-(-len(masks) // 8) * 8, self.size), np.uint8)
        wide[:len(masks)] = masks
        words = np.ascontiguousarray(wide.T).view(np.uint64)  # one row of 64-bit words for each document
        order = np.lexsort(words.T) if words.shape[1] > 1 else np.argsort(words[:, 0], kind="stable")
        ranked = words[order]
        fresh = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)])
        begin = np.flatnonzero(fresh)
        bound = self.most[at] @ bits[:, order[begin]].astype(np.int64)
        count = np.diff(np.append(begin, self.size))
        turn = np.argsort(-bound, kind="stable")
        turn = turn[bound[turn] >= best.needed]
        upto = np.cumsum(count[turn])
        i, share = 0, best.top
        while i < len(turn) and bound[turn[i]] >= best.needed:
            j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + share, side="left")) + 1
            some = turn[i:j]
            some = some[bound[some] >= best.needed]
            docs = order[np.repeat(begin[some] - np.cumsum(count[some]) + count[some], count[some]) + np.arange(count[some].sum())]
            r, d = np.nonzero(bits[:, docs])
            scores = np.zeros(len(docs), np.int64)
            np.add.at(scores, d, self.gain[np.searchsorted(self.key, at[r] * self.size + docs[d])])
            best.add(scores, self.ids[docs], self.null[docs])
            i, share = j, share * 2


def _searcher(shared):
    """Index rows → the best documents of every item among the rows of one task."""
    def run(batches):
        items, weights, n_docs, n_terms, needed, top = shared.value
        best = [Best(top, s) for s in needed]

        def work(rows):
            chunk = Chunk(rows, weights, n_docs, n_terms)
            for terms, b in zip(items, best):
                chunk.search(terms, b)

        rows, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if rows and size + len(r["doc_ids"]) > CHUNK_DOCS:
                    work(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r["doc_ids"])
        if rows:
            work(rows)
        no = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.scores) for b in best])
        if len(no):
            yield pa.RecordBatch.from_arrays([
                pa.array(no), pa.array(np.concatenate([b.ids for b in best]), mask=np.concatenate([b.null for b in best])),
                pa.array(np.concatenate([b.scores for b in best]))], names=["item_no", "doc_id", "score"])
    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block_pairs: int = BLOCK_PAIRS,
                   first_docs: int = FIRST_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item, see the head of this module for the cases."""
    spark = docs.sparkSession
    table, blocks = item_terms(items, block_pairs=block_pairs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    path, kind = new_path(spark, "ranked"), table.schema["item_id"].dataType.simpleString()
    result = f"item_id {kind}, rank int, doc_id bigint, score bigint"
    spark.createDataFrame([], result).write.parquet(path)
    for block in range(blocks):
        rows = table.where(F.col("block") == block).select("item_id", "terms").collect()
        if rows:
            _block(texts, rows, top, first_docs, f"item_no int, item_id {kind}").select(
                "item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(result).parquet(path)


def _block(texts: DataFrame, rows: list, top: int, first_docs: int, names: str) -> DataFrame:
    spark = texts.sparkSession
    terms = sorted({t for r in rows for t in r["terms"]})
    number = {t: i for i, t in enumerate(terms)}
    # -2 marks the end of a text
    words = spark.sparkContext.broadcast({**{t.encode("utf-8", "surrogatepass"): i for t, i in number.items()}, b"\0": -2})
    index = stage(texts.mapInArrow(_indexer(words), INDEX_SCHEMA), "index")
    sums = index.agg(F.sum("n_docs"), F.sum("n_terms"), F.max("task")).first()
    n_docs, n_terms = int(sums[0] or 0), int(sums[1] or 0)
    known = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], names)
    empty = spark.createDataFrame([], FOUND_SCHEMA)
    if not n_terms:
        return _ranked(empty, top).join(known, "item_no")
    held = index.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy("terms").agg(F.sum("counts").alias("df"))
    w = F.floor(F.lit(1000) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = np.zeros(len(terms), np.int64)
    for r in held.select("terms", w.alias("w")).toLocalIterator():  # at most one row for each term of the block
        weights[r["terms"]] = r["w"]
    wanted = [np.array([number[t] for t in r["terms"]], np.int64) for r in rows]

    def found(part: DataFrame, needed: list[int]) -> DataFrame:
        shared = spark.sparkContext.broadcast((wanted, weights, n_docs, n_terms, needed, top))
        return part.mapInArrow(_searcher(shared), FOUND_SCHEMA)

    # a score that `top` documents reach: whatever is below it cannot be among the best
    needed = [0] * len(rows)
    tasks = sums[2] + 1
    share = max(math.ceil(tasks / FIRST_SHARE), math.ceil(tasks * first_docs / n_docs))
    first = _ranked(found(index.where(F.col("task") < share), needed), top).where(F.col("rank") == top)
    for r in first.select("item_no", "score").collect():
        needed[r["item_no"]] = r["score"]
    return _ranked(found(index, needed), top).join(F.broadcast(known), "item_no")
