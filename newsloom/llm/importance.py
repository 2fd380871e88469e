"""Quality classifier by importance resampling: two n-gram models and Gumbel top-k.

The target model counts in how many documents labelled good each n-gram stands, the raw model does so for all documents. A document's
weight is the ratio of the probabilities of its distinct n-grams under both. Adding Gumbel noise to the log-weights (times
``SHARPNESS``) and keeping the k largest keys is sampling without replacement in proportion to the (sharpened) weights. k follows from labelled documents held out from the target model: it is the number of
documents on the good side of the cut that separates them best.

An n-gram seen within a factor of two, or within chance, of what the raw model expects weighs nothing: small differences between
languages or sources would otherwise add up over long texts. Rare n-grams are never clear of chance there, so the same is asked of the labelled
training rows alone: an n-gram whose documents are good clearly less often than the training rows are speaks against a document, however
rare it is in the whole table. N-grams are words (letters and digits, lower case), pairs of neighbouring words, and word shapes (the kinds of characters in a word).

An n-gram is known by a slot of 32 bits inside its bucket. Buckets grow in number with the input and hold about ``BUCKET_ENTRIES`` entries,
so that hardly any two n-grams ever share a slot. Counts are a Spark table: chunks of texts send each bucket their slots and
counts, packed; buckets are summed and weighed apart, and only slots with a weight stay. Scoring reads those in parts of bounded size.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import BASES, Rolling, distinct, mix64, window_starts
from .licences import WORD_BYTES
from .recurrence import pack_places, unpack_places

#: bits of a slot inside its bucket; entries of a bucket, summed in one task; texts counted at once
INNER, BUCKET_ENTRIES, TEXTS = 32, 2_000_000, 4096
#: slots with a weight that one pass of scoring holds; more of them take further passes over the texts
MODEL_SLOTS = 2_000_000
#: pseudo-count of the ratio in a slot; least factor and least deviation (in standard deviations) that count; power of the weights
PRIOR, FACTOR, DEVIATION, SHARPNESS = 1.0, 2.0, 3.0, 4.0
#: least deviation of the counts in good and bad training rows, as the root of the log-likelihood ratio statistic
LABEL_DEVIATION = 4.0
#: at most about so many labelled rows are used; one half trains the models, the other places the cut
LABELLED = 20_000
CHUNK_CHARS = 2_000_000
SEED = 7
FEW = 10_000
_KIND = bytes(85 if 65 <= i <= 90 else 108 if 97 <= i <= 122 or i >= 128 else 57 if 48 <= i <= 57 else i for i in range(256))


class Features(dict):
    """white-space word → its number; ``plain`` and ``shape`` hold the hashes of its letters and digits and of its shape.

    Words are remembered from chunk to chunk while there are at most ``most`` of them.
    """

    def __init__(self, most: int = 150_000):
        self.most, self.plain, self.shape = most, array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        import xxhash

        kinds = word.translate(_KIND)
        shape = bytes(c for i, c in enumerate(kinds) if i == 0 or c != kinds[i - 1])
        self.plain.append(xxhash.xxh3_64_intdigest(word.translate(WORD_BYTES).replace(b" ", b"")))
        self.shape.append(xxhash.xxh3_64_intdigest(shape, seed=1))
        self[word] = n = len(self.plain) - 1
        return n

    def of(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.most:
            self.clear()
            self.plain, self.shape = array("Q"), array("Q")
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.array(self.plain, np.uint64)[numbers], np.array(self.shape, np.uint64)[numbers]


def slot_bits(chars: int) -> int:
    """Bits of a slot: two n-grams a word, a word every six characters, and as many buckets (a power of two) as those need."""
    return INNER + min(max(math.ceil(math.log2(max(chars / 3 / BUCKET_ENTRIES, 1))), 6), 63 - INNER - TEXTS.bit_length())


def slots(texts: list, bits: int, features: Features, pair: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(slot, index of its text) of the distinct n-grams of each of at most TEXTS texts."""
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    lengths = np.array([len(s) for s in split], np.int64)
    plain, shape = features.of([w for s in split for w in s])
    owner = np.repeat(np.arange(len(texts)), lengths)
    at = np.flatnonzero(window_starts(lengths, 2))
    hashes = np.concatenate([mix64(plain), mix64(pair(plain))[at], mix64(shape)]) >> np.uint64(64 - bits)
    seen = distinct((np.concatenate([owner, owner[at], owner]) << bits) + hashes.astype(np.int64))
    return seen & ((1 << bits) - 1), seen >> bits


def chunks(texts: pa.Array):
    """(from, to, texts) of slices of at most CHUNK_CHARS characters and TEXTS texts; no more of a batch are Python strings at once."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and (size + n > CHUNK_CHARS or i - start == TEXTS):
            yield start, i, texts.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths), texts.slice(start).to_pylist()


def labelled_sample(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(_label_id, good, train): a bounded sample by the hash of the id; a document with several labels must be good in all."""
    total = labels.count()
    share = math.ceil(min(1.0, most / max(total, 1)) * 1_000_000)
    some = labels.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share))
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return some.groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.min(good).alias("good")).withColumn(
        "train", F.pmod(F.xxhash64("_label_id", F.lit("fold")), F.lit(2)) == 0)


def fit_models(rows: DataFrame) -> tuple[DataFrame, int]:
    """(slot, weight) of the slots with a weight, and the bits of a slot; ``rows`` has text, train_good and train_bad."""
    total, n_good, n_bad, chars = rows.agg(F.count(F.lit(1)), F.count_if("train_good"), F.count_if("train_bad"), F.sum(F.octet_length("text"))).first()
    bits = slot_bits(chars or 0)

    def run(batches):
        features, pair = Features(), Rolling(2, BASES[0])
        edges = np.arange((1 << (bits - INNER)) + 1) << INNER
        for batch in batches:
            good, bad = (np.array(batch[c].to_pylist(), bool) for c in ("train_good", "train_bad"))
            for a, b, texts in chunks(batch["text"]):
                slot, owner = slots(texts, bits, features, pair)
                ranked = np.sort(slot)
                first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
                keys = ranked[first]
                counts = [np.diff(first, append=len(ranked))]
                for some in (good[a:b], bad[a:b]):
                    counts.append(np.bincount(np.searchsorted(keys, slot[some[owner]]), minlength=len(keys)) if some.any() else None)
                cuts = np.searchsorted(keys, edges)
                used = np.flatnonzero(np.diff(cuts))
                parts = list(zip(used.tolist(), cuts[used].tolist(), cuts[used + 1].tolist()))
                blobs = [[c[i:j].astype("<u2").tobytes() if c is not None else b"" for _, i, j in parts] for c in counts]
                inner = keys & ((1 << INNER) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pack_places(inner[i:j]) for _, i, j in parts], pa.binary()),
                                                  *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "slots", "raw", "good", "bad"])

    def weigh(group: pa.Table) -> pa.Table:
        keys = [unpack_places(x) for x in group["slots"].to_pylist()]
        every = np.concatenate(keys)
        order = np.argsort(every)
        ranked = every[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sums = []
        for name in ("raw", "good", "bad"):
            blobs = group[name].to_pylist()
            count = np.concatenate([np.frombuffer(x, "<u2") if x else np.zeros(len(k), "<u2") for x, k in zip(blobs, keys)])
            sums.append(np.add.reduceat(count[order].astype(np.int64), first).astype(float))
        weight = slot_weights(*sums, total, n_good, n_bad)
        some = np.flatnonzero(weight)
        return pa.table({"slot": pa.array(ranked[first[some]] + (group["bucket"][0].as_py() << INNER), pa.int64()), "weight": pa.array(weight[some])})

    packed = rows.select("text", "train_good", "train_bad").mapInArrow(run, "bucket int, slots binary, raw binary, good binary, bad binary")
    return stage(packed.groupBy("bucket").applyInArrow(weigh, "slot long, weight double"), "model"), bits


def slot_weights(raw: np.ndarray, good: np.ndarray, bad: np.ndarray, total: int, n_good: int, n_bad: int) -> np.ndarray:
    """log P(target) − log P(raw) where clear; where the labelled rows speak against an n-gram, their ratio if that is lower."""
    ratio, labelled = log_ratio(raw, good, n_good / max(total, 1)), label_ratio(good, bad, n_good, n_bad)
    return np.where(labelled < 0, np.minimum(labelled, ratio), ratio)


def label_ratio(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int) -> np.ndarray:
    """As ``log_ratio`` with the good and bad training rows in place of all documents; 0 unless clearly negative.

    Clear means by the log-likelihood ratio of the two counts, which stays right for counts of a few documents.
    """
    if not n_good or not n_bad:
        return np.zeros(len(good))
    n, share = good + bad, n_good / (n_good + n_bad)
    ratio = np.log((good + PRIOR) / (n * share + PRIOR))
    deviation = 2 * sum(c * np.log(np.maximum(c, 1) / np.maximum(n * s, 1e-9)) for c, s in ((good, share), (bad, 1 - share)))
    return np.where((ratio <= -math.log(FACTOR)) & (deviation >= LABEL_DEVIATION ** 2), ratio, 0.0)


def log_ratio(raw: np.ndarray, target: np.ndarray, share: float) -> np.ndarray:
    """``share`` is the target's part of all documents, so ``raw`` × ``share`` is what a neutral target would hold."""
    expected = raw * share
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    clear = (np.abs(ratio) >= math.log(FACTOR)) & (np.abs(target - expected) >= DEVIATION * np.sqrt(expected + 1))
    return np.where(clear, ratio, 0.0)


def log_weights(rows: DataFrame, model: DataFrame, bits: int, most: int = MODEL_SLOTS) -> DataFrame:
    """(_id, _th, good, train, n_features, log_weight) of each row; one pass for each part of the model of about ``most`` slots."""
    schema = "_id long, _th long, good boolean, train boolean, n_features long, log_weight double"
    parts = max(1, math.ceil(model.count() / most))
    rows = rows.select("_id", "_th", "good", "train", F.lit(0).cast("long").alias("n_features"), F.lit(0.0).alias("log_weight"), "text")
    for k in range(parts):
        part = model.where(F.pmod(F.xxhash64("slot"), F.lit(parts)) == k).orderBy("slot").toPandas()
        weights = rows.sparkSession.sparkContext.broadcast((part["slot"].to_numpy(np.int64), part["weight"].to_numpy(float)))
        rows = rows.mapInArrow(_pass(weights, bits), f"{schema}, text string")
    return rows.drop("text")


def _pass(model, bits: int):
    def run(batches):
        features, pair = Features(), Rolling(2, BASES[0])
        known, weights = model.value
        mask = (1 << min(max(len(known).bit_length() + 4, 10), 26)) - 1
        maybe = np.zeros(mask + 1, bool)
        maybe[known & mask] = True
        for batch in batches:
            sums, n = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for a, b, texts in chunks(batch["text"]):
                slot, owner = slots(texts, bits, features, pair)
                n[a:b] = np.bincount(owner, minlength=b - a)
                at = np.flatnonzero(maybe[slot & mask])
                if len(at):
                    place = np.minimum(np.searchsorted(known, slot[at]), len(known) - 1)
                    sums[a:b] = np.bincount(owner[at], np.where(known[place] == slot[at], weights[place], 0.0), minlength=b - a)
            total = np.asarray(batch["log_weight"].to_numpy(zero_copy_only=False)) + sums
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_th"], batch["good"], batch["train"], pa.array(n), pa.array(total), batch["text"]],
                                             names=["_id", "_th", "good", "train", "n_features", "log_weight", "text"])

    return run


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The log-weight between two labelled documents that gives the best mean of both recalls; 0 without both classes."""
    if not len(good) or good.all() or not good.any():
        return 0.0 if len(good) == 0 or good.any() and not good.all() else (-math.inf if good.all() else math.inf)
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    # a cut before position i keeps i and what follows
    gain = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum() + np.concatenate([[g.sum()], g.sum() - np.cumsum(g)]) / g.sum()
    fits = np.concatenate([[True], w[1:] > w[:-1], [True]])
    i = int(np.argmax(np.where(fits, gain, -1)))
    return -math.inf if i == 0 else math.inf if i == len(w) else float((w[i - 1] + w[i]) / 2)


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows with the largest key, ties by _id and _th; exact, by narrowing down the cut with histograms of bounded size."""
    if k <= 0:
        return rows.limit(0)
    sure, rest = None, rows
    while True:
        low, high, n = rest.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        if n <= k:
            picked = rest
            break
        if n <= FEW or low == high:
            picked = rest.orderBy(F.col(key).desc(), "_id", "_th").limit(k)
            break
        bins = 2048
        place = F.least(F.floor((F.col(key) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
        above = 0
        for b, c in sorted(((r.b, r.c) for r in rest.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True):
            if above + c > k:
                break
            above += c
        part = rest.where(place > b)
        sure = part if sure is None else sure.unionByName(part)
        rest, k = rest.where(place == b), k - above
        if k == 0:
            return sure
    return picked if sure is None else sure.unionByName(picked)


def resample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, _th, n_features, log_weight, key, kept.

    Null, empty and blank texts have no n-grams and weight 1 (log 0); rows without any n-gram are never kept. The noise depends on id, text
    and seed alone, so repeated rows share one decision. Null ids have no label but are judged like others; other columns are ignored. Without labelled
    documents of both classes held out, all documents with n-grams are kept (none if all are bad). An empty table gives an empty result.
    """
    sample = F.broadcast(labelled_sample(labels, labelled))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), "text")
    rows = rows.join(sample, F.col("_id") == F.col("_label_id"), "left").withColumns({
        "train_good": F.coalesce(F.col("good") & F.col("train"), F.lit(False)),
        "train_bad": F.coalesce(~F.col("good") & F.col("train"), F.lit(False))})
    weighed = stage(log_weights(rows, *fit_models(rows)), "weights")
    held = weighed.where(~F.col("train") & (F.col("n_features") > 0)).select("log_weight", "good").toPandas()  # bounded by ``labelled``
    cut = best_cut(held["log_weight"].to_numpy(float), held["good"].to_numpy(bool))
    # without evidence for or against it a document is not rejected
    cut = min(cut, 0.0) if len(held) else -math.inf
    u = (F.pmod(F.xxhash64("_id", "_th", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = weighed.withColumn("key", SHARPNESS * F.col("log_weight") - F.log(-F.log(u)))
    able = keyed.where("n_features > 0")
    k = able.where(F.col("log_weight") >= cut).count()
    kept = top_k(able, "key", k).groupBy("_id", "_th").agg(F.lit(True).alias("kept"))
    a, b = keyed.alias("a"), kept.alias("b")
    return a.join(b, F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._th") == F.col("b._th")), "left").select(
        F.col("a._id").alias("doc_id"), F.col("a._th").alias("_th"), "n_features", "log_weight", "key", F.coalesce("kept", F.lit(False)).alias("kept"))
