"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

Everything runs as DataFrame functions. Two first-order character models are trained from a labelled sample: what the fixed patterns find
(random strings) and tokens of texts where they find nothing (ordinary identifiers). A long token outside the fixed spans
is a further secret when the mean log-likelihood ratio of its character pairs exceeds a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three kinds of secrets, their patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ["assign", "access", "hex", "markov"]

TOKEN = "[A-Za-z0-9+/_=-]{20,}"
WORD = "[A-Za-z0-9+/_.=-]{4,}"
#: about so many documents give random strings, and so many ordinary tokens, to the models
RANDOM_DOCS, ORDINARY_DOCS = 20_000, 500
THRESHOLD = 0.4
CODES = 128
SPAN = "struct<start:int,stop:int,kind:int>"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _spans(text: Column, found: Column, pattern: str, kind: int, good) -> Column:
    """Spans of matches: what stands between matches (split) and the matches make up the text again."""
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["g"])
        stop = begin + F.length(pair["m"])
        span = F.struct(begin.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"))
        return F.struct(stop.alias("at"), F.when(good(pair["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def _value(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def base_matches(rows: DataFrame, text: str = "_t") -> DataFrame:
    """Adds m_assign, m_access, m_hex: the matches of each kind, failing ones of assign included.

    A run of ``[0-9a-f]`` is matched whole or not at all, so asking for its least length in the pattern drops the same
    runs as asking afterwards; the same holds for access keys. An assignment that fails still uses up its characters.
    """
    t = F.col(text)
    return rows.withColumns({
        "m_assign": _matches(t, ASSIGN),
        "m_access": _matches(t, _least(ACCESS, ACCESS_LEAST - 4)),
        "m_hex": _matches(t, _least(HEX, HEX_LEAST)),
    })


def _least(pattern: str, n: int) -> str:
    return f"{pattern[:-1]}{{{n},}}"


def _sample(docs: DataFrame, most: int, total: int, salt: str) -> DataFrame:
    share = min(1.0, most / max(total, 1))
    return docs.where(F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(1_000_000)) < math.ceil(share * 1_000_000))


def pair_counts(docs: DataFrame, random_docs: int = RANDOM_DOCS, ordinary_docs: int = ORDINARY_DOCS) -> dict[tuple[int, str], int]:
    """(label, two characters) → count, from the labelled sample; at most two tables of ASCII pairs come to the driver."""
    total = docs.count()
    found = base_matches(_sample(docs, random_docs, total, "random"))
    random = found.select(F.explode(F.concat(
        F.transform(F.filter("m_assign", lambda m: F.length(_value(m)) >= ASSIGN_LEAST), _value), "m_access", "m_hex")).alias("s"))
    plain = base_matches(_sample(docs, ordinary_docs, total, "ordinary")).where(
        (F.size("m_assign") == 0) & (F.size("m_access") == 0) & (F.size("m_hex") == 0))
    # a token of several documents is an ordinary one; random strings that no pattern finds stand in a single document
    words = plain.select("_id", F.explode(F.array_distinct(_matches(F.col("_t"), WORD))).alias("s"))
    ordinary = words.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    both = random.select("s", F.lit(1).alias("label")).unionByName(ordinary.select("s", F.lit(0).alias("label"))).where(F.length("s") > 1)
    pairs = both.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, 2))).alias("pair"))
    return {(r.label, r.pair): r["count"] for r in pairs.groupBy("label", "pair").count().collect()}


def ratio_table(counts: dict[tuple[int, str], int], weight: float = 8.0) -> list[float]:
    """log P(next | char, random) − log P(next | char, ordinary) for each pair of ASCII codes.

    Each model backs off to its single-character distribution, so a context it never saw still tells what may follow.
    """
    logs = []
    for k in (0, 1):
        after, single = [0.0] * CODES, [0.5] * CODES
        for (label, pair), n in counts.items():
            if label == k:
                after[ord(pair[0]) % CODES] += n
                single[ord(pair[1]) % CODES] += n
        total = sum(single)
        logs.append([math.log((counts.get((k, chr(a) + chr(b)), 0) + weight * single[b] / total) / (after[a] + weight))
                     for a in range(CODES) for b in range(CODES)])
    return [round(r - o, 6) for o, r in zip(*logs)]


def _ratio(token: Column, table: Column) -> Column:
    """Mean over the character pairs of a token."""
    code = lambda i: F.ascii(F.substring(token, i, 1))
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0),
                        lambda acc, i: acc + F.element_at(table, code(i) * CODES + code(i + 1) + 1))
    return total / (F.length(token) - 1)


def with_spans(docs: DataFrame, threshold: float = THRESHOLD, counts: dict[tuple[int, str], int] | None = None) -> DataFrame:
    """The columns of ``docs`` in _row, then _id, _t (text, empty for null), base and spans: arrays of (start, stop, kind).

    Positions are code points, stop exclusive; spans are ordered by start, then kind, and hold base and Markov spans, which never touch a
    base span. ``counts`` takes a model trained before; otherwise two small jobs train it.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"),
                       F.coalesce("text", F.lit("")).alias("_t"))
    counts = pair_counts(rows.select("_id", "_t")) if counts is None else counts
    if not any(label == 1 for label, _ in counts):
        counts = {}
    # a constant that Spark folds once; a table of fixed size
    table = F.split(F.lit(",".join(map(str, ratio_table(counts)))), ",").cast("array<double>")
    found = base_matches(rows).withColumn("m_token", _matches(F.col("_t"), TOKEN))
    any_match = lambda m: F.lit(True)
    t = F.col("_t")
    found = found.withColumn("base", F.concat(
        _spans(t, F.col("m_assign"), ASSIGN, 0, lambda m: F.length(_value(m)) >= ASSIGN_LEAST),
        _spans(t, F.col("m_access"), _least(ACCESS, ACCESS_LEAST - 4), 1, any_match),
        _spans(t, F.col("m_hex"), _least(HEX, HEX_LEAST), 2, any_match)))
    found = found.withColumn("base", F.array_sort("base", _by_start_kind))
    found = found.withColumn("more", _spans(t, F.col("m_token"), TOKEN, 3, lambda m: _ratio(m, table) > threshold))
    apart = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return found.select("_row", "_id", "_t", "base", F.array_sort(F.concat(F.col("base"), apart), _by_start_kind).alias("spans"))


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD, counts: dict[tuple[int, str], int] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base and spans as in ``with_spans``.

    Null texts count as empty and have no spans; repeated rows and null ids are scanned like others; other columns are ignored; an empty
    table gives an empty result. A table without any base match has nothing to learn from: the ratio is then zero and
    no Markov span is added.
    """
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return with_spans(docs, threshold, counts).select(F.col("_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"),
                                                      count(2).alias("n_hex"), "base", "spans")


def redact_secrets(docs: DataFrame, mark: str = "[redacted]", **options) -> DataFrame:
    """``docs`` with every secret in text replaced by ``mark``; n_chars, where there is such a column, follows the new text."""
    found = with_spans(docs, **options)
    some = F.size("spans") > 0
    found = found.withColumn("_new", F.when(some, redact(F.col("_t"), F.col("spans"), mark)).otherwise(F.col("_row.text")))
    out = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": F.col("_new")}
    if "n_chars" in out:
        out["n_chars"] = F.when(some, F.length("_new").cast("long")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[v.alias(c) for c, v in out.items()])


def _by_start_kind(a: Column, b: Column) -> Column:
    key = lambda x: x["start"] * F.lit(8).cast("long") + x["kind"]
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def digest(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"),
                                                                 x["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[redacted]") -> Column:
    """The text with every stretch covered by spans (ascending) replaced by ``mark``; overlapping spans become one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        apart = x["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"),
                        F.when(apart, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))
