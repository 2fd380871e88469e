"""Benchmark decontamination: q-gram lemma filter, then banded alignment.

Every stretch of 64 characters of an item is a segment, whatever its start. If a text region matches a segment of m characters with at
most e edits, they share at least m − q + 1 − q·e q-grams, all on neighbouring diagonals (text position − item position). The index holds
each q-gram of an item once, so overlapping segments don't make it larger. Shared q-grams are looked at in overlapping bands of diagonals:
where enough of them lie within one segment, the segments there are aligned, ``NEAR`` neighbouring starts at a time. First what
these have in common is aligned, which leaves out most of them, then single segments; those within e edits are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, Rolling, distinct, mix64, slices

Q, SEGMENT, EDIT_PERCENT = 8, 64, 10
SHORTEST = 24
#: neighbouring starts that are aligned together and reported as one match
NEAR = 16
#: characters of benchmark items in one broadcast index; more items take further passes over the texts
INDEX_CHARS = 2_000_000
CHUNK_CHARS = 2_000_000
GAP = 0x110000  # no character
BITS = 22
ALIGNED = 256
SCHEMA = "_id long, _th long, text string, matches array<struct<item_id:long,start:int,stop:int,edits:int>>"


def normal(text: str | None) -> str:
    """Lower case, every run of white space one blank: the form that is compared."""
    return " ".join(text.lower().split()) if text else ""


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def edit_budget(m: int) -> int:
    """At most EDIT_PERCENT of the segment, and so few that the q-gram bound stays positive."""
    return min(m * EDIT_PERCENT // 100, (m - Q) // Q)


def banded_distances(patterns: np.ndarray, texts: np.ndarray, most: int) -> list[tuple[int, int, int] | None]:
    """For each pair of rows: (edits, from, to) of the best place of the pattern inside the text, or None beyond ``most`` edits.

    ``patterns`` and ``texts`` are matrices with one pair per row; texts are padded with GAP. All pairs advance together, and pairs whose
    whole band exceeds ``most`` are left behind. Of equal places the one that ends first is reported.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(patterns)
    k, n = texts.shape
    open_rows = np.arange(k)
    index = np.arange(n + 1, dtype=np.int16)
    cost, origin = np.zeros((k, n + 1), np.int16), np.tile(index, (k, 1))
    for i in range(patterns.shape[1]):
        across = np.empty_like(cost)
        across[:, 0] = most + 1 + i
        np.add(cost[:, :-1], texts != patterns[:, i:i + 1], out=across[:, 1:])
        down = cost + np.int16(1)
        diagonal = across <= down
        fresh = np.where(diagonal, across, down) - index
        begin = origin.copy()
        begin[:, 1:] = np.where(diagonal[:, 1:], origin[:, :-1], origin[:, 1:])
        # insertions: running minimum of cost − position
        low = np.minimum.accumulate(fresh, axis=1)
        source = np.maximum.accumulate(np.where(fresh == low, index, np.int16(0)), axis=1)
        cost, origin = low + index, np.take_along_axis(begin, source.astype(np.int64), axis=1)
        if i % 4 == 3 or i == patterns.shape[1] - 1:
            alive = cost.min(axis=1) <= most
            if not alive.all():
                cost, origin, patterns, texts, open_rows = cost[alive], origin[alive], patterns[alive], texts[alive], open_rows[alive]
            if not len(open_rows):
                return out
    ends = cost.argmin(axis=1)
    for r, c, o, end in zip(open_rows, cost, origin, ends):
        out[r] = (int(c[end]), int(o[end]), int(end))
    return out


def banded_distance(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    return banded_distances(pattern[None, :], text[None, :], most)[0]


class QGramIndex:
    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[int] = []
        self.codes: list[np.ndarray] = []
        roll = Rolling(Q, BASES[0])
        grams, owner, place = [], [], []
        for item, text in items:
            codes = codes_of(normal(text))
            if len(codes) < SHORTEST:
                continue
            g = mix64(roll(codes))
            grams.append(g)
            owner.append(np.full(len(g), len(self.items)))
            place.append(np.arange(len(g)))
            self.items.append(item)
            self.codes.append(codes)
        none = np.zeros(0, np.int64)
        g = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(g, kind="stable")
        self.owner, self.place = np.concatenate([none, *owner])[order], np.concatenate([none, *place])[order]
        self.grams, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.lengths = np.array([len(c) for c in self.codes], np.int64)
        self.sizes = np.minimum(self.lengths, SEGMENT)
        self.edits = np.array([edit_budget(m) for m in self.sizes.tolist()], np.int64)
        self.bounds = self.sizes - Q + 1 - Q * self.edits
        self.width = 2 * int(self.edits.max(initial=0)) + 1
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[(self.grams >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.roll = Rolling(Q, BASES[0])

    def matches(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(index of the item, from, to, edits) in one array of texts joined by gaps.

        Of up to NEAR neighbouring starts (from a multiple of NEAR) that match in one band the first is reported where that one matches,
        else the one with the fewest edits.
        """
        if not len(self.grams) or len(codes) < Q:
            return []
        g = mix64(self.roll(codes))
        at = np.flatnonzero(self.maybe[(g >> np.uint64(64 - BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        same = self.grams[slot] == g[at]
        at, slot = at[same], slot[same]
        if not len(at):
            return []
        n = self.count[slot]
        take = np.repeat(self.first[slot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place = self.place[take]
        owner, diagonal = self.owner[take], np.repeat(at, n) - place
        w = self.width
        lowest = int(diagonal.min()) // w - 1
        band = diagonal // w - lowest
        bands = int(band.max()) + 2
        key = owner * bands + band
        # a band is two strips, one strip apart; each q-gram of the item counts once in it
        longest = int(self.lengths.max())
        seen = distinct(np.concatenate([key, key - 1]) * longest + np.concatenate([place, place]))
        key, place = seen // longest, seen % longest
        owner = np.clip(key // bands, 0, len(self.items) - 1)
        # enough q-grams from here on within one segment: the segment starts between the two
        last = np.minimum(np.arange(len(seen)) + self.bounds[owner] - 1, len(seen) - 1)
        span = self.sizes[owner] - Q
        good = (np.arange(len(seen)) + self.bounds[owner] - 1 < len(seen)) & (key[last] == key) & (place[last] - place <= span) & (key >= 0)
        low = np.maximum(place[last] - span, 0)[good] // NEAR
        high = np.minimum(place, self.lengths[owner] - self.sizes[owner])[good] // NEAR
        n = high - low + 1
        group = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found = distinct(np.repeat(key[good], n) * longest + group)
        todo = []
        for k, c in zip((found // longest).tolist(), (found % longest).tolist()):
            i, strip = divmod(k, bands)
            first = c * NEAR
            todo.append((i, (strip + lowest) * w, first, min(first + NEAR - 1, int(self.lengths[i] - self.sizes[i]))))
        # what the segments have in common, then the first of them, then the others
        core = self._align([(i, at, b, int(self.sizes[i]) - (b - a)) for i, at, a, b in todo], codes, NEAR)
        todo = [t for t, hit in zip(todo, core) if hit]
        heads = self._align([(i, at, a, int(self.sizes[i])) for i, at, a, _ in todo], codes)
        out = [(t[0], *hit) for t, hit in zip(todo, heads) if hit]
        rest = [(r, i, at, s) for r, ((i, at, a, b), hit) in enumerate(zip(todo, heads)) if not hit for s in range(a + 1, b + 1)]
        best: dict[int, tuple] = {}
        for (r, i, _, s), hit in zip(rest, self._align([(i, at, s, int(self.sizes[i])) for _, i, at, s in rest], codes)):
            if hit and (r not in best or (hit[2], s) < best[r][:2]):
                best[r] = (hit[2], s, (i, *hit))
        return sorted(out + [x[2] for x in best.values()])

    def _align(self, wanted: list[tuple[int, int, int, int]], codes: np.ndarray, more: int = 0) -> list[tuple[int, int, int] | None]:
        """(from, to, edits) or None for each (item, lowest diagonal, start, length); those of one length and edit budget together."""
        out: list[tuple[int, int, int] | None] = [None] * len(wanted)
        alike: dict[tuple, list] = {}
        for r, (i, at, s, m) in enumerate(wanted):
            most = int(self.edits[i])
            lo, hi = max(at + s - most - more, 0), min(at + 2 * self.width + s + m + most + more, len(codes))
            if hi > lo:
                alike.setdefault((m, most), []).append((r, lo, hi))
        for (m, most), part in alike.items():
            for k in range(0, len(part), ALIGNED):
                some = part[k:k + ALIGNED]
                texts = np.full((len(some), max(hi - lo for _, lo, hi in some)), GAP, np.uint32)
                for row, (_, lo, hi) in zip(texts, some):
                    row[:hi - lo] = codes[lo:hi]
                patterns = np.array([self.codes[wanted[r][0]][wanted[r][2]:wanted[r][2] + m] for r, _, _ in some], np.uint32)
                for (r, lo, _), hit in zip(some, banded_distances(patterns, texts, most)):
                    if hit:
                        out[r] = (lo + hit[1], lo + hit[2], hit[0])
        return out


def bounded_items(benchmark: DataFrame, limit: int = INDEX_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in slices of at most ``limit`` characters (or one item), fetched slice by slice."""
    part, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if part and size + len(r.text) > limit:
            yield part
            part, size = [], 0
        part.append((r.item_id, r.text))
        size += len(r.text)
    if part:
        yield part


def _pass(items):
    none = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())]))

    def run(batches):
        index = QGramIndex(items.value)
        for batch in batches:
            texts, before = batch["text"].to_pylist(), batch["matches"].to_pylist()
            out = [list(b) for b in before]
            for a, b in slices(texts, CHUNK_CHARS):
                parts, starts, at = [], [], 0
                for t in texts[a:b]:
                    codes = codes_of(normal(t))
                    starts.append(at)
                    parts += [codes, np.full(Q, GAP, np.uint64)]
                    at += len(codes) + Q
                for i, lo, hi, edits in index.matches(np.concatenate(parts)):
                    d = int(np.searchsorted(starts, lo, side="right")) - 1
                    out[a + d].append({"item_id": index.items[i], "start": lo - starts[d], "stop": hi - starts[d], "edits": edits})
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_th"], batch["text"], pa.array(out, none)], names=["_id", "_th", "text", "matches"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, _th, contaminated, n_matches, items (ids ascending), matches.

    Matches are positions in the normalised text (lower case, single blanks), distinct; of NEAR neighbouring segments one is listed. A passage counts when any 64
    characters in a row (the whole item where it is shorter, 24 at least) are found with at most a tenth of them edited. Null and
    empty texts and items match nothing; items of fewer than 24 characters are no evidence. Repeated rows and items, null ids and
    extra columns change nothing for other rows. Empty tables give an empty result or no matches.
    """
    sc = docs.sparkSession.sparkContext
    kind = "array<struct<item_id:long,start:int,stop:int,edits:int>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), "text", F.array().cast(kind).alias("matches"))
    for part in bounded_items(benchmark, index_chars):
        rows = rows.mapInArrow(_pass(sc.broadcast(part)), SCHEMA)
    distinct = F.array_sort(F.array_distinct("matches"))
    return rows.select(F.col("_id").alias("doc_id"), "_th", (F.size("matches") > 0).alias("contaminated"), F.size(distinct).cast("long").alias("n_matches"),
                       F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull()))).alias("items"),
                       distinct.alias("matches"))
