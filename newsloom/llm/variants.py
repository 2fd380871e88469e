"""SimHash near-dedup by deletion variants.

Method: a fingerprint is cut into so few segments that two within the distance always have one that differs by at most one bit (three
segments for four bits). Each segment is indexed once for each of its bits with that bit left out: two segments that differ by at most one bit have a variant in
common. Fingerprints with an equal variant come together by an equality shuffle and are verified on all bits.

Equal fingerprints have collapsed to one before. A bucket gives at most one link for each member, whatever the group's
size, and buckets that are too large for a task are cut by variants of their other bits (``operators.buckets``). The number of candidates grows with
the square of the distinct fingerprints over 2^21.

Case-folded words are parted by ASCII whitespace; a text with fewer words than the width is one shingle; null, empty and blank texts have the
fingerprint zero, which links like any other. Rows repeated with one id get equal results; a null doc_id takes part but
is never the smallest, so a component of such rows alone has a null id. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.buckets import LIMIT, close_links
from ..operators.clusters import connected_components
from ..scale import attach_counted
from ..session import stage
from .common import ASCII_LOWER, ASCII_UPPER, slices

BITS = 4
WIDTH = 4
SEED = 42
SLICE_BYTES = 1_000_000
#: shingles counted together: sums of 16 bits cannot overflow
PIECE = 60_000
LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
PRINT_SCHEMA = "doc_id bigint, fp bigint"


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of all word shingles of a text, repeats included."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(len(words) - width + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(width, len(words)) - 1:].tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, stops)], repeat(SEED)), np.uint64, n)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each array: the bits set in over half of its values; 0 for none."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    if not sizes.sum():
        return out
    pieces = np.maximum(-(-sizes // PIECE), 1)
    owner = np.repeat(np.arange(len(hashes)), pieces)
    every = np.concatenate(hashes)
    first = np.cumsum(sizes) - sizes
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first[owner] + turn * PIECE
    full = sizes[owner] > 0
    owner, start = owner[full], start[full]
    counts = np.zeros((64, len(hashes)), np.int64)
    lanes, sixteen = np.uint64(0x0001_0001_0001_0001), np.uint64(0xFFFF)
    for bit in range(16):  # four bits at a time, each counted in a quarter of a word
        sums = np.add.reduceat((every >> np.uint64(bit)) & lanes, start)
        for lane in range(4):
            np.add.at(counts[bit + 16 * lane], owner, ((sums >> np.uint64(16 * lane)) & sixteen).astype(np.int64))
    for bit in range(64):
        out |= (2 * counts[bit] > sizes).astype(np.uint64) << np.uint64(bit)
    return out


def _prints(width: int):
    def run(batches):
        for batch in batches:
            texts, out = batch["text"].to_pylist(), []
            for a, b in slices(texts, SLICE_BYTES):
                out.append(majority([shingle_hashes(t or b"", width) for t in texts[a:b]]))
            if out:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(out).view(np.int64))], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_prints(width), PRINT_SCHEMA)


def variant_masks(mask: int, bits: int = BITS) -> list[int]:
    """``mask`` and one segment of the other bits but for one of its bits, for all segments and bits.

    With bits // 2 + 1 segments one of them has at most one of ``bits`` differing bits.
    """
    free, parts = [b for b in range(64) if not mask >> b & 1], bits // 2 + 1
    cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        segment = sum(1 << b for b in free[lo:hi])
        out += [mask | segment & ~(1 << b) for b in free[lo:hi]]
    return out


def near_components(docs: DataFrame, bits: int = BITS, width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable over fingerprints with at most ``bits`` differing bits."""
    marked = stage(fingerprints(docs, width), "marked")
    prints = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    links = close_links(prints, bits, lambda mask: variant_masks(mask, bits), "fp", limit=limit)
    linked = connected_components(links, "a", "b")
    named = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    lookup = stage(attach_counted(named, stage(lowest, "lowest"), ["component"], "members").select("fp", "component_id", "n"), "lookup")
    return attach_counted(marked, lookup, ["fp"], "n").select("doc_id", "fp", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
