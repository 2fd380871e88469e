"""Source divergence audit: how far the word use of each source is from the other sources and from its language.

Method: the kept vocabulary of a language, terms in at least ``least`` of its documents, is found by iceberg prefix
refinement. The texts are packed once: one row per chunk of documents and language, with the chunk's sorted terms and the term
numbers of each document. Level by level the terms' byte prefixes grow. At each level a document counts once for each prefix it holds;
prefixes in too few documents are discarded with all terms below them, and the longer prefixes of the next level are taken from the
others only. A term carries an end mark, so it is complete as soon as the prefix length reaches it; the levels end when no incomplete prefix is left.
Which prefixes survived reaches the tasks as a bitmap of their hashes, of bounded size: a false hit costs a row more, never a wrong result, since
every level counts exactly. Occurrences of kept terms by source are then dealt to blocks by term, so no source, language or word is
a task of its own; a block adds up the differences of all pairs of sources and keeps each source's best terms.

Rows count as documents, repeated ones as often as they occur; doc_id and other columns are not read. Null text, lang and source are ''. A
group without terms has pairs; with no kept term in its language all their values are 0. A source alone in its language has no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import slices

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
SLICE_BYTES = 1_000_000
CHUNK_BYTES = 6_000_000
#: (source, term) pairs that a task adds up before it sends them
HELD_USES = 600_000
#: rows of (source, term) in a block
BLOCK_ROWS = 500_000
#: bits of the bitmap of surviving prefixes: 16 for each prefix, within these limits (16 MB at most)
LEAST_BITS, MOST_BITS = 16, 27
BUCKET_BYTES = 4096

_KEPT = [c >= 0x80 or chr(c).isalpha() for c in range(256)]
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if _KEPT[c] else 32 for c in range(256))

CHUNK_SCHEMA = "lang string, sources array<string>, source_of binary, sizes binary, ranks binary, tfs binary, terms binary"
PREFIX_SCHEMA = "lang string, prefix binary, docs bigint"
USE_SCHEMA = "lang string, source string, term binary, n bigint"
PART_SCHEMA = "lang string, source string, part string, item string, value bigint"


def level_lengths() -> Iterator[int]:
    """Prefix lengths in bytes: from where words begin to differ, doubling."""
    yield from (6 << i for i in count())


def _pack(a: np.ndarray) -> bytes:
    top = int(a.max()) if len(a) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


class Numbers(dict):
    """term → number in the order of first occurrence; 0 is the mark that ends a text."""

    def __init__(self):
        super().__init__({b"\0": 0})

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


class Pack:
    """Documents of one language in one chunk."""

    def __init__(self):
        self.numbers, self.source_no = Numbers(), {}
        self.found, self.lengths, self.source_of = [], [], []

    def add(self, texts: list[bytes], sources: list[str]) -> None:
        words = (b" \0 ".join(t.translate(FOLD) for t in texts) + b" \0").split()
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.found.append(number[number > 0])
        self.lengths.append(np.diff(np.flatnonzero(number == 0), prepend=-1) - 1)
        self.source_of += [self.source_no.setdefault(s, len(self.source_no)) for s in sources]

    def row(self, lang: str) -> tuple:
        terms = list(self.numbers)[1:]
        order = sorted(range(len(terms)), key=terms.__getitem__)
        rank = np.empty(len(terms) + 1, np.int64)
        rank[np.array(order, np.int64) + 1] = np.arange(len(terms))
        lengths = np.concatenate(self.lengths)
        doc = np.repeat(np.arange(len(lengths)) << 32, lengths)
        once, tf = np.unique(doc | rank[np.concatenate(self.found)], return_counts=True)
        sizes = np.bincount(once >> 32, minlength=len(lengths))
        return (lang, list(self.source_no), _pack(np.array(self.source_of)), _pack(sizes), _pack(once & 0xFFFFFFFF), _pack(tf),
                b"\0".join(terms[i] for i in order))


def _chunks(batches):
    """Rows (lang, source, text as bytes) → packed rows."""
    packs, size = {}, 0

    def flush():
        cols = zip(*[p.row(lang) for lang, p in packs.items()])
        kinds = (pa.string(), pa.list_(pa.string()), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, cols), kinds)],
                                          names=["lang", "sources", "source_of", "sizes", "ranks", "tfs", "terms"])

    for batch in batches:
        langs, sources, texts = (batch[c].to_pylist() for c in ("lang", "source", "text"))
        for a, b in slices(texts, SLICE_BYTES):
            members = {}
            for i in range(a, b):
                members.setdefault(langs[i], []).append(i)
            for lang, rows in members.items():
                packs.setdefault(lang, Pack()).add([texts[i] for i in rows], [sources[i] for i in rows])
            size += sum(map(len, texts[a:b]))
            if size > CHUNK_BYTES:
                yield flush()
                packs, size = {}, 0
    if packs:
        yield flush()


class Survivors:
    """Bitmap over the hashes of (lang, prefix)."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def holds(self, lang: str, keys: list[bytes]) -> np.ndarray:
        import xxhash

        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
        h = np.fromiter(map(xxhash.xxh64_intdigest, keys, repeat(seed)), np.uint64, len(keys)) & np.uint64((1 << self.bits) - 1)
        at = h.astype(np.int64)
        return (self.words[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def survivors(prefixes: DataFrame) -> Survivors:
    """The bitmap of a staged table of (lang, prefix); at most 2^MOST_BITS bits come to the driver."""
    n = prefixes.count()
    bits = min(max(LEAST_BITS, (16 * n).bit_length()), MOST_BITS)
    place = F.pmod(F.xxhash64("lang", "prefix"), F.lit(1 << bits)) + 1
    buckets = prefixes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    words = np.zeros((1 << bits) // 8, np.uint8)
    for r in buckets.toLocalIterator():
        words[(r["b"] - 1) * BUCKET_BYTES:r["b"] * BUCKET_BYTES] = np.frombuffer(r["m"], np.uint8)
    return Survivors(bits, words)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One packed row at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _runs(keys: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct keys of a sorted list, and the number of its distinct key for each entry."""
    fresh = np.fromiter((a != b for a, b in zip(keys, [None, *keys])), bool, len(keys))
    return [keys[i] for i in np.flatnonzero(fresh)], np.cumsum(fresh) - 1


def _prefix_counts(length: int, before: int, shared):
    """Documents of each prefix of ``length`` bytes below the surviving prefixes of ``before`` bytes, by chunk."""
    def run(batches):
        for batch in batches:
            for r in _rows(batch):
                terms = r["terms"].split(b"\0") if r["terms"] else []
                alive = np.fromiter((len(t) >= before for t in terms), bool, len(terms))
                at = np.flatnonzero(alive)
                if before and len(at):
                    heads, own = _runs([terms[i][:before] for i in at])
                    at = at[shared.value.holds(r["lang"], heads)[own]]
                if not len(at):
                    continue
                keys, own = _runs([(terms[i] + b"\0")[:length] for i in at])
                number = np.full(len(terms), -1, np.int64)
                number[at] = own
                sizes, n = _unpack(r["sizes"]), number[_unpack(r["ranks"])]
                doc = np.repeat(np.arange(len(sizes)), sizes)
                doc, n = doc[n >= 0], n[n >= 0]
                # terms of a document are sorted, so equal prefixes stand together
                once = np.concatenate([[True], (doc[1:] != doc[:-1]) | (n[1:] != n[:-1])])
                docs = np.bincount(n[once], minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array(docs, pa.int64())],
                                                 names=["lang", "prefix", "docs"])
    return run


def kept_terms(chunks: DataFrame, least: int = LEAST_DOCS, lengths: Iterator[int] | None = None) -> DataFrame:
    """(lang, prefix) of all complete terms, end mark included, in at least ``least`` documents of their language."""
    spark, kept, before, shared = chunks.sparkSession, [], 0, None
    for length in lengths or level_lengths():
        counted = chunks.mapInArrow(_prefix_counts(length, before, shared), PREFIX_SCHEMA)
        level = stage(counted.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "prefix"), "prefixes")
        if shared is not None:
            shared.destroy()
        done = F.expr("right(hex(prefix), 2) = '00'")
        kept.append(level.where(done))
        rest = level.where(~done)
        if rest.isEmpty():
            break
        shared, before = spark.sparkContext.broadcast(survivors(rest)), length
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return stage(out, "vocabulary")


class Uses:
    """Occurrences by (source, term) of one language, added up over chunks."""

    def __init__(self):
        self.terms, self.sources = Numbers(), {}
        self.keys, self.counts, self.size = [], [], 0

    def add(self, terms: list[bytes], sources: list[str], source: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        own = np.fromiter(map(self.terms.__getitem__, terms), np.int64, len(terms))
        names = np.array([self.sources.setdefault(s, len(self.sources)) for s in sources], np.int64)
        self.keys.append((names[source] << 32) | own[term])
        self.counts.append(tf)
        self.size += len(tf)
        self._merge()

    def _merge(self) -> None:
        key, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        n = np.bincount(back, np.concatenate(self.counts), len(key)).astype(np.int64)  # exact below 2^53
        self.keys, self.counts, self.size = [key], [n], len(key)

    def batch(self, lang: str) -> pa.RecordBatch:
        key, terms = self.keys[0], pa.array(list(self.terms), pa.binary())
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(key), pa.string()), pa.array(list(self.sources), pa.string()).take(pa.array(key >> 32)),
            terms.take(pa.array(key & 0xFFFFFFFF)), pa.array(self.counts[0], pa.int64())], names=["lang", "source", "term", "n"])


def _uses(shared):
    """Occurrences by source of the terms that the bitmap holds, added up within a task while they are no more than ``HELD_USES``."""
    def run(batches):
        held = {}
        for batch in batches:
            for r in _rows(batch):
                terms = [t + b"\0" for t in r["terms"].split(b"\0")] if r["terms"] else []
                if not terms:
                    continue
                good = shared.value.holds(r["lang"], terms)
                sizes, ranks, tf = _unpack(r["sizes"]), _unpack(r["ranks"]), _unpack(r["tfs"])
                source, hit, place = np.repeat(_unpack(r["source_of"]), sizes), good[ranks], np.cumsum(good) - 1
                held.setdefault(r["lang"], Uses()).add([terms[i] for i in np.flatnonzero(good)], r["sources"], source[hit], place[ranks[hit]], tf[hit])
                if sum(u.size for u in held.values()) > HELD_USES:
                    for lang, u in held.items():
                        yield u.batch(lang)
                    held = {}
        for lang, u in held.items():
            yield u.batch(lang)
    return run


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 · n / total) for n ≤ total < 9·10^15, exact in 64 bits: long division by thousands."""
    whole, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return 1 + whole


def _block(top: int):
    """One block of a language's terms: differences of all pairs of sources added up, and each source's best terms."""
    def run(uses: pa.Table, groups: pa.Table) -> pa.Table:
        out = {k: [] for k in ("lang", "source", "part", "item", "value")}
        names = sorted(groups["source"].to_pylist())
        by = {r["source"]: r for r in groups.to_pylist()}
        lang = groups["lang"][0].as_py()
        size = np.array([by[s]["total"] + by[s]["vocabulary"] for s in names], np.int64)
        whole = by[names[0]]["lang_total"] + by[names[0]]["vocabulary"]
        pairs = np.zeros((len(names), len(names)), np.int64)
        best = [[] for _ in names]

        def emit(source, part, item, value):
            for k, v in zip(out, (lang, source, part, item, int(value))):
                out[k].append(v)

        if len(uses):
            coded = uses["term"].combine_chunks().dictionary_encode()
            terms, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            place = {s: i for i, s in enumerate(names)}
            source = np.fromiter(map(place.__getitem__, uses["source"].to_pylist()), np.int64, len(uses))
            n = uses["n"].to_numpy()
            order = np.argsort(number, kind="stable")
            number, source, n = number[order], source[order], n[order]
            step = max(1, 1_000_000 // len(names))
            for lo in range(0, len(terms), step):
                a, b = np.searchsorted(number, [lo, lo + step])
                use = np.zeros((min(step, len(terms) - lo), len(names)), np.int64)
                use[number[a:b] - lo, source[a:b]] = n[a:b]
                p = share(use + 1, size)
                q = share(use.sum(axis=1) + 1, np.int64(whole))
                for g in range(len(names)):
                    d = p[:, [g]] - p
                    pairs[g] += (d * d // p).sum(axis=0)
                    more = np.flatnonzero((use[:, g] > 0) & (p[:, g] > q))
                    value = (p[more, g] - q[more]) ** 2 // q[more]
                    if len(value) > top:
                        good = value >= np.partition(value, len(value) - top)[len(value) - top]
                        more, value = more[good], value[good]
                    best[g] += [(-int(v), terms[lo + t]) for v, t in zip(value, more)]
                    best[g] = sorted(best[g])[:top]
        for g, s in enumerate(names):
            for h, other in enumerate(names):
                if g != h:
                    emit(s, "pair", other, pairs[g, h])
            for v, t in best[g]:
                emit(s, "term", t[:-1].decode("utf-8", "surrogatepass"), -v)
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})
    return run


def audit_sources(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, block_rows: int = BLOCK_ROWS,
                  lengths: list[int] | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language, part ``term`` the ``top`` terms
    that a source uses more than its language; see the head of this module for the cases."""
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                        F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    groups = plain.groupBy("lang", "source").agg(F.lit(1).alias("_one")).drop("_one")
    chunks = stage(plain.mapInArrow(_chunks, CHUNK_SCHEMA), "packed")
    kept = kept_terms(chunks, least, _endless(lengths) if lengths else None)
    words = spark.sparkContext.broadcast(survivors(kept))
    # tasks have added up their own rows already: dealt out first, there is nothing for Spark to combine before the shuffle
    found = chunks.mapInArrow(_uses(words), USE_SCHEMA).repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    exact = kept.withColumnRenamed("prefix", "term").hint("shuffle_hash")
    uses = stage(found.join(exact, ["lang", "term"], "left_semi"), "uses")
    words.destroy()

    totals = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"))
    every = stage(groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "rows", "vocabulary"]), "groups")
    by_lang = every.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    blocks = max(1, math.ceil((every.agg(F.sum("rows")).first()[0] or 0) / block_rows))
    heads = every.join(by_lang, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = uses.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks).cast("long")))
    parts = stage(dealt.groupBy("lang", "block").cogroup(heads.groupBy("lang", "block")).applyInArrow(_block(top), PART_SCHEMA), "parts")

    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(w)).unionByName(terms)


def _endless(lengths: list[int]) -> Iterator[int]:
    """Given lengths, then doubled ones."""
    yield from lengths
    yield from islice((lengths[-1] << i for i in count(1)), 64)
