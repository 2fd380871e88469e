"""Links between 64-bit values of small Hamming distance, without making all pairs of a group.

Values are put into buckets, one for each mask of a list: ``value & mask`` names the bucket. The list must be complete, that is, two
values within the distance agree on at least one mask. One shuffle brings a bucket's members together, sorted, and tasks walk over the
buckets as a stream. A bucket gives the links of a spanning forest, at most one for each member, instead of its pairs: a member that
has been reached is never compared with another one of the same tree. Buckets beyond ``limit`` members are not
held; they leave the stream and are cut by longer masks in a further pass, until their members agree on all but a few bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

LIMIT = 50_000
SMALL = 32
#: a bucket whose mask leaves so many bits open has 2^8 members at most
OPEN_BITS = 8
INDEX_SCHEMA = "bucket bigint, mask bigint, h bigint, fresh boolean"
LINK_SCHEMA = "a bigint, b bigint, mask bigint, fresh boolean"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _expand(refine: Callable[[int], list[int]]):
    """Rows (mask, h, fresh) → one row for each mask of ``refine(mask)``."""
    def run(batches):
        for batch in batches:
            mask, h = batch["mask"].to_numpy().view(np.uint64), batch["h"].to_numpy().view(np.uint64)
            fresh = batch["fresh"].to_numpy(zero_copy_only=False)
            for m in np.unique(mask):
                rows, new = h[mask == m], fresh[mask == m]
                for finer in refine(int(m)):
                    f = np.uint64(finer)
                    bucket = _mix(_mix(rows & f) + f)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket.view(np.int64)), pa.array(np.full(len(rows), f).view(np.int64)), pa.array(rows.view(np.int64)), pa.array(new)],
                        names=["bucket", "mask", "h", "fresh"])
    return run


def spanning(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph that joins values within ``bits`` differing bits."""
    a, b, todo = [], [], h
    while len(todo) > 1:
        reached, todo = todo[:1], todo[1:]
        while len(reached) and len(todo):
            found = []
            if len(todo) < len(reached):
                left = []
                for x in todo:
                    near = np.flatnonzero(np.bitwise_count(reached ^ x) <= bits)
                    if len(near):
                        a.append(reached[near[:1]])
                        b.append(np.array([x], np.uint64))
                        found.append(b[-1])
                    else:
                        left.append(x)
                # all of the reached ones have met all of the others now
                reached, todo = reached[:0], np.array(left, np.uint64)
            else:
                pivot, reached = reached[-1], reached[:-1]
                near = np.bitwise_count(todo ^ pivot) <= bits
                if near.any():
                    found.append(todo[near])
                    a.append(np.full(len(found[-1]), pivot))
                    b.append(found[-1])
                    todo = todo[~near]
            reached = np.concatenate([reached, *found])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _walk(bits: int, limit: int, siblings: list[int], only_fresh: bool):
    """Sorted index rows → links (a, b), and the members of buckets beyond the limit as (h, null, mask)."""
    def batch_of(a, b, mask, fresh):
        kind = pa.int64()
        none = pa.nulls(len(a), kind)
        return pa.RecordBatch.from_arrays([
            pa.array(a.view(np.int64), kind), none if b is None else pa.array(b.view(np.int64), kind),
            none if mask is None else pa.array(mask.view(np.int64), kind), pa.nulls(len(a), pa.bool_()) if fresh is None else pa.array(fresh)],
            names=["a", "b", "mask", "fresh"])

    table = np.array(siblings, np.uint64)
    by_mask = np.argsort(table)

    def earlier(x, mask):
        """Does a mask before the own one join the pair too? Then its bucket links it."""
        out = np.zeros(len(x), bool)
        if len(table) and len(x):
            own = by_mask[np.searchsorted(table[by_mask], mask)]
            for i, m in enumerate(table[:-1]):
                out |= (own > i) & ((x & m) == 0)
        return out

    def can_leave(mask):
        """Masks that leave few bits open have few members: they are held whatever the limit."""
        return 64 - int(np.bitwise_count(mask).max()) > OPEN_BITS

    def solve(bucket, mask, h, fresh):
        if len(h) < 2:
            return
        start = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (mask[1:] != mask[:-1])]))
        size = np.diff(np.append(start, len(h)))
        run = np.repeat(np.arange(len(start)), size)
        if only_fresh:
            wanted = np.maximum.reduceat(fresh, start)
            keep = wanted[run]
            if not keep.all():
                yield from solve(bucket[keep], mask[keep], h[keep], fresh[keep])
                return
        small = size[run] <= SMALL
        for shift in range(1, min(SMALL, len(h))):
            same = np.flatnonzero((run[shift:] == run[:-shift]) & small[shift:])
            if not len(same):
                break
            x = h[same] ^ h[same + shift]
            near = (np.bitwise_count(x) <= bits) & (x != 0)
            if only_fresh:
                near &= fresh[same] | fresh[same + shift]
            at, x = same[near], x[near]
            at = at[~earlier(x, mask[at])]
            if len(at):
                yield batch_of(h[at], h[at + shift], None, None)
        for s, n in zip(start[size > SMALL], size[size > SMALL]):
            members, own = h[s:s + n], mask[s:s + n]
            if n > limit and can_leave(own):
                yield batch_of(members, None, own, fresh[s:s + n])
            else:
                a, b = spanning(members, bits)
                if len(a):
                    yield batch_of(a, b, None, None)

    def run(batches):
        held, leaving = None, None
        for batch in batches:
            rows = [batch["bucket"].to_numpy(), *(batch[c].to_numpy().view(np.uint64) for c in ("mask", "h")), batch["fresh"].to_numpy(zero_copy_only=False)]
            if leaving is not None:
                k = int(np.searchsorted(rows[0], leaving, side="right"))
                if k:
                    yield batch_of(rows[2][:k], None, rows[1][:k], rows[3][:k])
                rows = [r[k:] for r in rows]
                if not len(rows[0]):
                    continue
                leaving = None
            if held is not None:
                rows = [np.concatenate(p) for p in zip(held, rows)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from solve(*[r[:cut] for r in rows])
            held = [r[cut:] for r in rows]
            if len(held[0]) > limit and can_leave(held[1]):
                leaving = held[0][0]
                yield batch_of(held[2], None, held[1], held[3])
                held = None
        if held is not None:
            yield from solve(*held)
    return run


def close_links(values: DataFrame, bits: int, refine: Callable[[int], list[int]], column: str = "h", fresh: str | None = None,
                limit: int = LIMIT) -> DataFrame:
    """Links (a, b) that connect every two distinct ``values`` within ``bits`` differing bits, directly or over others that are.

    ``values`` are distinct and not null. ``refine(0)`` is the complete list of masks to begin with; for one of these, ``refine(mask)`` has longer masks,
    complete for values that agree on ``mask``, each of them longer while more than ``OPEN_BITS`` bits are open. With ``fresh``, a boolean column, only buckets with a fresh value are looked at: their links
    complete an earlier result over the others.
    """
    rows = values.select(F.lit(0).cast("long").alias("mask"), F.col(column).alias("h"), (F.col(fresh) if fresh else F.lit(True)).alias("fresh"))
    siblings, links = refine(0), None
    while True:
        index = rows.mapInArrow(_expand(refine), INDEX_SCHEMA)
        if fresh and siblings:
            # old values come along only where a fresh one shares their bucket
            news = index.where("fresh").select("bucket").distinct()
            index = index.join(news, "bucket", "left_semi").select("bucket", "mask", "h", "fresh")
        walked = stage(index.repartition("bucket").sortWithinPartitions("bucket", "mask").mapInArrow(
            _walk(bits, limit, siblings, fresh is not None), LINK_SCHEMA), "walked")
        found = walked.where("b is not null").select("a", "b")
        links = found if links is None else links.unionByName(found)
        rows, siblings = walked.where("b is null").select("mask", F.col("a").alias("h"), "fresh"), []
        if rows.isEmpty():
            return links
