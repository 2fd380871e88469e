"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least 85 %.

Method: a metric-space join on the Jaccard distance d = 1 − J with link radius r.

1. *Shingle pivots.* Between unrelated documents every distance is 1, so documents can't be pivots for the whole
   table. The first pivots are one-shingle sets drawn from a third of all shingles (by hash): If d(x, y) ≤ r, at most
   k = ⌊0.15 |x|⌋ shingles of x are missing in y, so x can have a partner only if all but k of its pivots recur elsewhere
   (counted exactly over all documents). Documents with too few pivots for the bound use all their shingles.
2. *Cells.* A cell is a pair of neighbours in the sorted order of a set, so two documents that have a phrase in common hardly ever share one, but
   near copies do: a shingle that y lacks breaks two pairs of x and one that only y has breaks another, ⌊2 · 0.15 |x|⌋ pairs at
   most. So the first common cell of a pair is among the first ⌊2 · 0.15 |x|⌋ + 1 of either, in any common order, and a document lies in
   those cells only. The order is by rising frequency, from a sketch of fixed size, so that common passages hardly ever make cells.
   Cells of single shingles would connect more and more unrelated documents as the table grows, until most are one block.
3. *Blocks.* Cells that share documents form a block; documents of different blocks cannot link.
4. *Document pivots.* Inside a block distances tell something: Voronoi cells around far-apart documents, boundary
   documents replicated where d(x, q) ≤ d(x, home) + 2r, cells solved recursively. A cell that no longer shrinks is a dense
   cluster: its members outside the largest component are compared with those inside the windows |d(x, q) − d(y, q)| ≤ r.
   Blocks too large for a task are split the same way by Spark, and cells that don't shrink by pairs of bounded tiles.
All tests of links are exact integer comparisons of whole sets.

Sets are larger than their texts, so none is kept: each pass makes those it needs again, from the rows that a bitmap of bounded size lets
through, and what travels to a block is the packed text. Only blocks too large for a task have their sets staged.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.clusters import connected_components
from ..session import discard, drop_shuffles, new_path, stage
from .common import BASES, Rolling, WordHash, distinct, mix64, slices, text_key
from .recurrence import ENTRY_SCHEMA, bucket_count, entry_rows, linking, recurring, total_chars

WIDTH, PERCENT = 4, 85
PIVOT_SHARE = 3
CHUNK_CHARS = 6_000_000
#: shingles that one task holds at once; larger blocks are split by Spark
BLOCK_SHINGLES = 4_000_000
#: counters of the sketch that tells frequent pivots from rare ones; a fixed size, whatever the input
SKETCH = 1 << 21
BROADCAST_ROWS = 400_000
#: bits of the bitmap of picked rows: 32 for each row, within these limits (16 MB at most); a false hit costs a row more, never a wrong result
LEAST_BITS, MOST_BITS = 16, 27
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
SET_SCHEMA = "_id long, _th long, n_shingles long, node binary, near boolean"
LINK_SCHEMA = "num long, low long, _id long, _th long, n long"


def shingle_sets(texts: list, width: int, hasher: WordHash, rolling: Rolling) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle."""
    split = [t.encode("utf-8", "surrogatepass").translate(LOWER).split() if t else [] for t in texts]
    lengths = np.array([len(s) for s in split], np.int64)
    words = hasher.of([w for s in split for w in s])
    hashes, ends = mix64(rolling(words)), np.cumsum(lengths)
    out = []
    for n, end in zip(lengths.tolist(), ends.tolist()):
        if n >= width:
            out.append(distinct(hashes[end - n:end - width + 1]))
        elif n:
            place = np.arange(1, n + 1, dtype=np.uint64) * BASES[1]
            out.append(mix64(np.array([np.sum(mix64(words[end - n:end] + place), dtype=np.uint64) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def missing_bound(n: int, percent: int) -> int:
    """Shingles of a set of n that a linked set may lack."""
    return (100 - percent) * n // 100


def can_link(n: int, percent: int) -> bool:
    """Is there a different set that a set of n can link with?"""
    return 100 * n >= percent * (n + 1)


def pivots_of(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, bool]:
    """(pivots that take part in the count, are they all shingles?)"""
    if not can_link(len(shingles), percent) and not can_link(len(shingles) - 1, percent):
        return shingles[:0], False
    own = shingles[shingles % np.uint64(PIVOT_SHARE) == 0]
    return (own, False) if len(own) > missing_bound(len(shingles), percent) else (shingles, True)


def sketch_slots(pivots: np.ndarray) -> np.ndarray:
    return (mix64(pivots ^ BASES[0]) >> np.uint64(43)).astype(np.int64)


def run_length(percent: int) -> int:
    """Shingles of a cell: two neighbours where every set that can link has more such pairs than a partner may break, else one."""
    return 2 if percent >= 50 and all(n - 1 > broken_bound(n, percent, 2) for n in range(1, 200) if can_link(n, percent)) else 1


def broken_bound(n: int, percent: int, run: int) -> int:
    """Runs of neighbours of a set of n that a linked set may lack: a shingles that it lacks break ``run`` each, b that only it has
    one less, and 100 a + percent b ≤ (100 − percent) n."""
    return run * (100 - percent) * n // 100


def runs_of(shingles: np.ndarray, percent: int, run: int) -> np.ndarray:
    """Hashes of the runs of neighbours in the sorted set; none for a set that cannot link."""
    if not can_link(len(shingles), percent):
        return shingles[:0]
    return shingles if run == 1 else mix64(shingles[:-1] * BASES[0] + shingles[1:])


def cells_of(shingles: np.ndarray, percent: int, run: int, frequency: np.ndarray) -> np.ndarray:
    """Cells that a document lies in: its first runs, rare ones first, one more than may be broken; ``frequency`` is the sketch."""
    runs = runs_of(shingles, percent, run)
    return runs[np.lexsort((runs, frequency[sketch_slots(runs)]))][:broken_bound(len(shingles), percent, run) + 1]


def _entries(width: int, percent: int, buckets: int):
    def run(batches):
        task, hasher, rolling, n = TaskContext.get().partitionId(), WordHash(), Rolling(width, BASES[0]), 0
        for batch in batches:
            ids, keys, texts = (batch[c].to_pylist() for c in ("_id", "_th", "text"))
            for a, b in slices(texts, CHUNK_CHARS):
                sets = shingle_sets(texts[a:b], width, hasher, rolling)
                chosen = [pivots_of(s, percent) for s in sets]
                need = [1 if every else len(p) - missing_bound(len(s), percent) for s, (p, every) in zip(sets, chosen)]
                lengths = np.array([len(p) for p, _ in chosen], np.int64)
                e = np.concatenate([p for p, _ in chosen])
                _, where, back, count = np.unique(e, return_index=True, return_inverse=True, return_counts=True)
                local, once = np.flatnonzero(count[back] > 1), np.sort(where)
                head = pickle.dumps((ids[a:b], keys[a:b], [len(s) for s in sets], [node_of(s) for s in sets], need, lengths, local))
                yield entry_rows(f"{task}-{n}", head, e[once], mix64(e[once] ^ BASES[1]), once, buckets)
                n += 1
    return run


def _finish(head: bytes, places: np.ndarray) -> pa.Table:
    ids, keys, sizes, nodes, need, lengths, local = pickle.loads(head)
    doc = np.searchsorted(np.cumsum(lengths), distinct(np.concatenate([places, local])), side="right")
    found = np.bincount(doc, minlength=len(ids))
    return pa.table({"_id": pa.array(ids, pa.int64()), "_th": pa.array(keys, pa.int64()), "n_shingles": pa.array(sizes, pa.int64()),
                     "node": pa.array(nodes, pa.binary()), "near": pa.array((found >= np.array(need)) & (lengths > 0), pa.bool_())})


class Block:
    """The sets of one block in one task: distances to a pivot, and the components of the links."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.radius = percent, 1 - percent / 100
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.marked = np.zeros(len(values), bool)
        self.root = np.arange(len(sets))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def distances(self, p: int, to: np.ndarray) -> np.ndarray:
        """From p to the members ``to``; those within the radius are joined with p."""
        own = self.ids[self.starts[p]:self.starts[p] + self.sizes[p]]
        self.marked[own] = True
        n = self.sizes[to]
        begins = np.cumsum(n) - n
        take = np.arange(int(n.sum())) + np.repeat(self.starts[to] - begins, n)
        common = np.add.reduceat(self.marked[self.ids[take]].astype(np.int64), begins)
        self.marked[own] = False
        union = n + self.sizes[p] - common
        a = self.find(p)
        for i in to[100 * common >= self.percent * union]:
            b = self.find(i)
            if a != b:
                a, b = min(a, b), max(a, b)
                self.root[b] = a
        return 1 - common / union

    def labels(self, of: np.ndarray) -> np.ndarray:
        return np.array([self.find(i) for i in of])

    def solve(self) -> np.ndarray:
        todo = [np.arange(len(self.sizes))]
        while todo:
            part = todo.pop()
            if len(part) < 2 or len(set(self.labels(part))) == 1:
                continue
            table = self._pivot_table(part)
            cells = self._cells(part, table) if len(part) > 64 else [part]
            if max(map(len, cells)) <= 0.7 * len(part) and sum(map(len, cells)) <= 3 * len(part):
                todo += cells
            else:
                self._dense(part, table)
        return self.labels(np.arange(len(self.sizes)))

    def _pivot_table(self, part: np.ndarray, most: int = 12) -> np.ndarray:
        """Distances of all of ``part`` to pivots taken farthest first."""
        rows, nearest, p = [], np.full(len(part), np.inf), 0
        for _ in range(min(most, len(part))):
            rows.append(self.distances(part[p], part))
            nearest = np.minimum(nearest, rows[-1])
            p = int(nearest.argmax())
            if nearest[p] == 0:
                break
        return np.array(rows)

    def _cells(self, part: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
        inside = table <= table.min(axis=0) + 2 * self.radius + 1e-9
        home = table.argmin(axis=0)
        return [part[row] for q, row in enumerate(inside) if (home == q).any()]

    def _dense(self, part: np.ndarray, table: np.ndarray) -> None:
        labels = self.labels(part)
        values, count = np.unique(labels, return_counts=True)
        for j in np.flatnonzero(labels != values[count.argmax()]):
            near = (np.abs(table - table[:, j:j + 1]) <= self.radius + 1e-9).all(axis=0)
            near &= (100 * np.minimum(self.sizes[part], self.sizes[part[j]]) >= self.percent * np.maximum(self.sizes[part], self.sizes[part[j]]))
            near[j] = False
            if near.any():
                self.distances(part[j], part[near])


def _solved(sets: dict[bytes, np.ndarray], percent: int) -> pa.Table:
    nodes = sorted(sets)
    labels = Block([sets[x] for x in nodes], percent).solve()
    return pa.table({"node": pa.array(nodes, pa.binary()), "root": pa.array([nodes[i] for i in labels], pa.binary())})


def _solve(percent: int):
    def run(group: pa.Table) -> pa.Table:
        return _solved({x: np.frombuffer(b, np.uint64) for x, b in zip(group["node"].to_pylist(), group["shingles"].to_pylist())}, percent)
    return run


def _solve_texts(width: int, percent: int):
    hasher, rolling = WordHash(), Rolling(width, BASES[0])

    def run(group: pa.Table) -> pa.Table:
        return _solved({node_of(s): s for s in shingle_sets(_unpacked(group["packed"]), width, hasher, rolling)}, percent)
    return run


def _voronoi(percent: int):
    radius = 1 - percent / 100

    def run(batches):
        for batch in batches:
            out = {"up": [], "cell": [], "node": [], "n": []}
            for block, node, n, blob, pivots in zip(*(batch[c].to_pylist() for c in ("block", "node", "n", "shingles", "pivots"))):
                own = np.frombuffer(blob, np.uint64)
                common = [len(np.intersect1d(own, np.frombuffer(p, np.uint64), assume_unique=True)) for p in pivots]
                d = [1 - c / (n + len(p) // 8 - c) for c, p in zip(common, pivots)]
                for q, x in enumerate(d):
                    if x <= min(d) + 2 * radius + 1e-9:
                        for k, v in zip(out, (block, q, node, n)):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["up"], pa.string()), pa.array(out["cell"], pa.int32()), pa.array(out["node"], pa.binary()),
                                              pa.array(out["n"], pa.int64())], names=list(out))
    return run


CELL_SCHEMA = "up string, cell int, node binary, n long"


def _split_large(members: DataFrame, large: DataFrame, percent: int, limit: int, pivots: int = 16) -> DataFrame:
    """(block, node, n) of blocks that a task can't hold → (block, node) of cells that it can; a few jobs per level.

    Only ids travel to the cells. A block whose largest cell stays above 70 % of it is cut into tiles instead, and each pair of tiles
    becomes a cell, so that any two members meet in one.
    """
    done = None
    while True:
        rank = Window.partitionBy("block").orderBy(F.xxhash64("node"), "node")
        chosen = large.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= pivots).select("block", "node")
        chosen = stage(chosen.join(members, "node").groupBy("block").agg(F.collect_list("shingles").alias("pivots")), "pivots")
        with_sets = large.select("block", "node").join(members, "node").join(chosen, "block")
        cells = stage(with_sets.select("block", "node", "n", "shingles", "pivots").mapInArrow(_voronoi(percent), CELL_SCHEMA), "cells")
        totals = stage(cells.groupBy("up", "cell").agg(F.sum("n").alias("total")), "totals")
        was = large.groupBy(F.col("block").alias("up")).agg(F.sum("n").alias("was"))
        judged = stage(totals.groupBy("up").agg(F.max("total").alias("most")).join(was, "up").select(
            "up", "was", (F.col("most") > 0.7 * F.col("was")).alias("stuck")), "judged")
        stuck = judged.where("stuck").select(F.col("up").alias("block"), F.ceil(F.col("was") * 4 / limit).alias("tiles"))
        tiled = large.join(stuck, "block").withColumn("_t", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn(
            "_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
            F.concat_ws(":", "block", F.least("_t", "_o"), F.greatest("_t", "_o")).alias("block"), "node")
        split = cells.join(totals, ["up", "cell"]).join(judged.where("not stuck").select("up"), "up").select(
            F.concat_ws("/", "up", "cell").alias("block"), "node", "n", "total")
        part = tiled.unionByName(split.where(F.col("total") <= limit).select("block", "node"))
        done = part if done is None else done.unionByName(part)
        large = stage(split.where(F.col("total") > limit).select("block", "node", "n"), "large")
        if large.isEmpty():
            return done


def _unpacked(texts) -> list[str]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(t).decode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def _sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(block, packed) → (block, node, n, shingles)."""
    def run(batches):
        hasher, rolling = WordHash(), Rolling(width, BASES[0])
        for batch in batches:
            blocks, texts = batch["block"].to_pylist(), _unpacked(batch["packed"])
            for i, j in slices(texts, CHUNK_CHARS // 4):
                found = shingle_sets(texts[i:j], width, hasher, rolling)
                yield pa.RecordBatch.from_arrays([
                    pa.array(blocks[i:j], pa.string()), pa.array([node_of(s) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64()),
                    pa.array([s.tobytes() for s in found], pa.binary())], names=["block", "node", "n", "shingles"])

    return texts.mapInArrow(run, "block string, node binary, n long, shingles binary")


def _slot(bits: int):
    return F.shiftrightunsigned(F.xxhash64(F.col("_id").cast("long"), F.col("_th")), 64 - bits)


def _bitmap(picked: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the slots of rows (_id, _th)."""
    part = min(bits, 15)

    def fill(group: pa.Table) -> pa.Table:
        here = np.zeros(1 << part, bool)
        here[group["slot"].to_numpy() & ((1 << part) - 1)] = True
        return pa.table({"part": group["part"][:1], "set": pa.array([np.packbits(here, bitorder="little").tobytes()], pa.binary())})

    slots = picked.select(_slot(bits).alias("slot")).select(F.shiftright("slot", part).alias("part"), "slot")
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in slots.groupBy("part").applyInArrow(fill, "part long, set binary").collect():
        out[r.part << part - 3:r.part + 1 << part - 3] = np.frombuffer(r.set, np.uint8)
    return out


def _let_through(batches, bitmap: np.ndarray):
    """Batches of the rows whose ``slot`` is set."""
    for batch in batches:
        slot = batch["slot"].to_numpy()
        own = batch.filter(pa.array((bitmap[slot >> 3] >> (slot & 7) & 1).astype(bool)))
        if own.num_rows:
            yield own


def _run_frequency(rows: DataFrame, picked, width: int, percent: int) -> np.ndarray:
    """Counts of hashed runs of the picked rows: SKETCH numbers, whatever the input; each task sends what it has counted once."""
    run = run_length(percent)

    def counts(batches):
        count, hasher, rolling = np.zeros(SKETCH, np.int64), WordHash(), Rolling(width, BASES[0])
        for batch in _let_through(batches, picked.value):
            texts = batch["text"].to_pylist()
            for i, j in slices(texts, CHUNK_CHARS // 4):
                found = [sketch_slots(runs_of(s, percent, run)) for s in shingle_sets(texts[i:j], width, hasher, rolling)]
                np.add.at(count, np.concatenate(found), 1)
        part = SKETCH // 64
        for i in range(64):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([count[i * part:(i + 1) * part].astype("<i4").tobytes()], pa.binary())],
                                             names=["part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, "<i4").astype(np.int64) for b in group["counts"].to_pylist())
        return pa.table({"part": group["part"][:1], "counts": pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())})

    found = rows.mapInArrow(counts, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros(SKETCH, np.int32)
    for r in found:
        out[r.part * (SKETCH // 64):(r.part + 1) * (SKETCH // 64)] = np.frombuffer(r.counts, "<i4")
    return out


def _cell_entries(width: int, percent: int, buckets: int, picked, frequency):
    """The cells of the picked rows as entries of ``linking``; rows of a chunk with a common cell are linked by the chunk itself."""
    run_of = run_length(percent)

    def run(batches):
        task, hasher, rolling, n = TaskContext.get().partitionId(), WordHash(), Rolling(width, BASES[0]), 0
        for batch in _let_through(batches, picked.value):
            ids, keys, texts = (batch[c].to_pylist() for c in ("_id", "_th", "text"))
            for a, b in slices(texts, CHUNK_CHARS):
                sets = shingle_sets(texts[a:b], width, hasher, rolling)
                cells = [cells_of(s, percent, run_of, frequency.value) for s in sets]
                owner = np.repeat(np.arange(len(sets)), [len(c) for c in cells])
                e = np.concatenate(cells)
                _, where, back = np.unique(e, return_index=True, return_inverse=True)
                first = owner[where][back]
                local = np.unique(np.stack([owner, first])[:, owner != first], axis=1)
                once = np.sort(where)
                head = pickle.dumps((ids[a:b], keys[a:b], [len(s) for s in sets], local))
                yield entry_rows(f"{task}-{n}", head, e[once], mix64(e[once] ^ BASES[1]), owner[once], buckets)
                n += 1
    return run


def _links_of(head: bytes, base: int, owner: np.ndarray, low: np.ndarray) -> pa.Table:
    ids, keys, sizes, local = pickle.loads(head)
    pairs = np.stack([np.concatenate([owner, local[0], local[1]]), np.concatenate([low, base + local[1], base + local[1]])])
    at, low = np.unique(pairs, axis=1)
    pick = lambda values: pa.array([values[i] for i in at.tolist()], pa.int64())
    return pa.table({"num": pa.array(base + at, pa.int64()), "low": pa.array(low, pa.int64()), "_id": pick(ids), "_th": pick(keys), "n": pick(sizes)})


def _routed(picked):
    """Texts of the picked rows, packed for the shuffles that bring them to their blocks; of rows that repeat id and text one in a batch."""
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in _let_through(batches, picked.value):
            rows = dict(zip(zip(batch["_id"].to_pylist(), batch["_th"].to_pylist()), batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.int64()),
                pa.array([pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in rows.values()], pa.binary())], names=["_id", "_th", "packed"])
    return run


def linked_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(sets, roots): (_id, _th, n_shingles, node, near) of every row, and (node, root) of the nodes with links.

    Equal sets share one node. Runs several jobs and stages their results in the shared folder.
    """
    spark = docs.sparkSession
    rows = docs.select(*text_key(), "text")
    buckets = bucket_count(total_chars(docs) // 6 // PIVOT_SHARE)
    sets = stage(recurring(rows.mapInArrow(_entries(width, percent, buckets), ENTRY_SCHEMA), _finish, SET_SCHEMA), "sets")
    paths = [new_path(spark, name) for name in ("pick", "links", "placed", "large")]
    pick = stage(sets.where("near").groupBy("node").agg(F.min(F.struct("_id", "_th", "n_shingles")).alias("r")).select(
        "r._id", "r._th", "r.n_shingles").distinct(), "pick", path=paths[0])
    run = run_length(percent)
    count, cells = pick.agg(F.count(F.lit(1)), F.sum(F.floor(F.col("n_shingles") * (run * (100 - percent)) / 100) + 1)).first()
    bits = min(max((32 * count).bit_length(), LEAST_BITS), MOST_BITS)
    picked = spark.sparkContext.broadcast(_bitmap(pick, bits))
    near = rows.withColumn("slot", _slot(bits))
    frequency = spark.sparkContext.broadcast(_run_frequency(near, picked, width, percent))
    entries = near.mapInArrow(_cell_entries(width, percent, bucket_count(int(cells or 0)), picked, frequency), ENTRY_SCHEMA)
    links = stage(linking(entries, _links_of, LINK_SCHEMA), "links", path=paths[1])
    blocks = connected_components(links, "num", "low")
    # rows that repeat both id and text share all their cells; what else the bitmap let through goes
    found = links.select(F.col("num").alias("node"), "_id", "_th", "n").distinct().join(blocks, "node").groupBy("_id", "_th").agg(
        F.min("component").cast("string").alias("block"), F.max("n").alias("n"))
    found, own = found.alias("f"), pick.alias("k")
    placed = stage(found.join(own, F.col("f._id").eqNullSafe(F.col("k._id")) & (F.col("f._th") == F.col("k._th")), "left_semi"), "placed", path=paths[2])
    sizes = stage(placed.groupBy("block").agg(F.sum("n").alias("total")).where(F.col("total") > block_shingles), "sizes")
    t, p = near.mapInArrow(_routed(picked), "_id long, _th long, packed binary").alias("t"), _bounded(placed).alias("p")
    texts = t.join(p, F.col("t._id").eqNullSafe(F.col("p._id")) & (F.col("t._th") == F.col("p._th"))).select("p.block", "t.packed")
    solve = lambda some: some.groupBy("block").applyInArrow(_solve_texts(width, percent), "node binary, root binary")
    if sizes.isEmpty():
        roots = stage(solve(texts), "roots")
    else:
        large = stage(_sets_of(texts.join(sizes.select("block"), "block", "left_semi"), width), "large", path=paths[3])
        if large.count() > large.select("node").distinct().count():  # rows that repeat both id and text
            paths.append(new_path(spark, "large"))
            large = stage(large.dropDuplicates(["node"]), "large", path=paths[4])
        members = large.select("node", "n", "shingles")
        parts = stage(_split_large(members, large.select("block", "node", "n"), percent, block_shingles), "parts")
        solved = members.join(_bounded(parts), "node").groupBy("block").applyInArrow(_solve(percent), "node binary, root binary")
        solved = stage(solved.unionByName(solve(texts.join(sizes.select("block"), "block", "left_anti"))), "solved")
        joined = connected_components(solved, "node", "root")
        roots = joined.select("node", F.col("component").alias("root"))
    discard(spark, *paths)
    return sets, roots


def _bounded(rows: DataFrame) -> DataFrame:
    """Marked for broadcast while it has at most BROADCAST_ROWS narrow rows (some 20 MB), else as it is: Spark then shuffles."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def near_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, _th (hash of the text), n_shingles, group, component_id.

    group names the component (null without shingles); component_id is the smallest doc_id reachable over links, the own one included. Null, empty and blank texts have no
    shingles and link with nothing. Equal texts and repeated rows link; a null doc_id takes part but is never
    the smallest, so a component of such rows alone has a null id. Other columns are ignored, whatever their names. An
    empty table gives an empty result. ``docs`` must be a table or a staged result, see ``recurrence``.
    """
    with drop_shuffles(docs.sparkSession):
        return _named(*linked_sets(docs, width, percent, block_shingles))


def _named(sets: DataFrame, roots: DataFrame) -> DataFrame:
    classes = sets.where("n_shingles > 0").groupBy("node").agg(F.min("_id").alias("low"))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stage(named, "classes")
    joined = named.groupBy("root").agg(F.min("low").alias("component_id"))
    lookup = named.join(joined, "root").select("node", "root", "component_id")
    return sets.join(lookup, "node", "left").select(
        F.col("_id").alias("doc_id"), "_th", "n_shingles", F.col("root").alias("group"),
        F.when(F.col("n_shingles") == 0, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))
