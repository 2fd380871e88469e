"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Source shares of tokens are raised to an exponent between 0 (all sources alike) and 1 (as they are). The exponent is bisected until the
entropy of the weights meets a target and no source is repeated more often than allowed. A source with weight w gets
w × budget tokens: whole passes over all its documents, then part of a pass. That part takes the source's blocks in an order
permuted for the pass, and documents in a permuted order within the one block where the budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

BLOCKS = 512
#: share of the largest possible entropy, ln(sources)
ENTROPY_SHARE = 0.9
MAX_PASSES = 4.0
SEED = 11
#: exponents tried in one job, and jobs: the exponent is found to 1 / 32^5
GRID, ROUNDS = 32, 5


def sources_of(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(_id, _th, source, n_tokens, block) of each row; tokens are words between white space."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), source.alias("source"),
                       F.when(F.col("text").isNull(), 0).otherwise(words).cast("long").alias("n_tokens"),
                       F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(BLOCKS)).cast("int").alias("block"))


def _sums(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent, over sources of share p: (sum p^x, sum p^x ln p^x, max p^(x−1)), in one job."""
    aggs = []
    for i, x in enumerate(exponents):
        w = F.exp(x * F.col("lp"))
        aggs += [F.sum(w).alias(f"z{i}"), F.sum(w * x * F.col("lp")).alias(f"e{i}"), F.max((x - 1) * F.col("lp")).alias(f"m{i}")]
    r = totals.agg(*aggs).first()
    return [(r[f"z{i}"], r[f"e{i}"], math.exp(r[f"m{i}"])) for i in range(len(exponents))]


def _boundary(totals: DataFrame, good, at_low: bool) -> float:
    """Where ``good`` changes between exponents 0 and 1: the last for which it holds from 0 on (``at_low``), else the first from which it holds."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        below = [good(*s) == at_low for s in _sums(totals, grid)]
        if all(below):
            return grid[-1]
        if not below[0]:
            return grid[0]
        i = below.index(False)
        low, high = grid[i - 1], grid[i]
    return low if at_low else high


def bisect_exponent(totals: DataFrame, entropy: float, max_passes: float, budget_ratio: float) -> float:
    """The largest exponent up to 1 whose weights have at least ``entropy``, raised where a source would be repeated more than ``max_passes`` times.

    Entropy falls and repetition falls as the exponent grows, so both are bisected; ``totals`` has lp, the log-share of each source.
    """
    by_entropy = _boundary(totals, lambda z, e, m: math.log(z) - e / z >= entropy - 1e-12, True)
    # passes of the most repeated source: budget × w / tokens = ratio × p^x / (z × p)
    by_passes = _boundary(totals, lambda z, e, m: budget_ratio * m / z <= max_passes + 1e-12, False)
    return max(by_entropy, by_passes)


def mix_sources(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_passes: float = MAX_PASSES, budget: int | None = None,
                seed: int = SEED, budget_ratio: float = 1.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, _th, source, n_tokens, weight (of the source), passes (how often the row is taken), slot.

    ``budget`` is in tokens, by default those of the table times ``budget_ratio``. Each source gets at most weight × budget tokens and misses less than its longest document's. ``slot`` (0 to 1) orders
    one pass: rows by permuted block, so that sources interleave. A null source counts as the source ''. Null and blank texts have no
    tokens and ride along with their block; a source without tokens is left out (weight 0). Repeated rows share one decision; null ids are
    mixed like others; other columns are ignored; an empty table gives an empty result. Runs about a dozen small jobs.
    """
    rows = stage(sources_of(docs, seed), "mix")
    blocks = stage(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("source_tokens")).where("source_tokens > 0")
    every, n = totals.agg(F.sum("source_tokens"), F.count(F.lit(1))).first()
    if not n:
        return rows.select(F.col("_id").alias("doc_id"), "_th", "source", "n_tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("passes"),
                           F.lit(0.0).alias("slot"))
    budget = int(every * budget_ratio) if budget is None else budget
    totals = stage(totals.withColumn("lp", F.log(F.col("source_tokens") / float(every))), "totals")
    x = bisect_exponent(totals, entropy_share * math.log(n), max_passes, budget / every)
    z = _sums(totals, [x])[0][0]
    plan = totals.withColumn("weight", F.exp(x * F.col("lp")) / z).withColumn(
        "quota", F.least(F.floor(F.col("weight") * budget + 1e-6).cast("long"), F.floor(F.col("source_tokens") * max_passes + 1e-6).cast("long")))
    plan = plan.withColumn("full", F.floor(F.col("quota") / F.col("source_tokens")).cast("long")).withColumn(
        "room", F.col("quota") - F.col("full") * F.col("source_tokens"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", "full", F.lit(seed)), "block")
    turns = blocks.join(plan, "source").withColumns({"upto": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                                                     "rank": F.row_number().over(order)})
    turns = stage(turns.select("source", "block", "weight", "full", "rank", (F.col("room") - F.col("upto") + F.col("tokens")).alias("left"), "tokens"), "turns")
    placed = rows.join(turns, ["source", "block"], "left")
    # only blocks where the budget of a source ends are looked at document by document: one per source
    ends = placed.where((F.col("left") > 0) & (F.col("left") < F.col("tokens")))
    by_doc = Window.partitionBy("source", "block").orderBy(F.struct(F.xxhash64("_id", "_th", "full", F.lit(seed)), "_id", "_th"))
    fits = ends.withColumn("extra", (F.sum("n_tokens").over(by_doc) <= F.col("left")).cast("long"))
    rest = placed.where(~F.coalesce((F.col("left") > 0) & (F.col("left") < F.col("tokens")), F.lit(False))).withColumn(
        "extra", F.coalesce((F.col("left") >= F.col("tokens")) & (F.col("left") > 0), F.lit(False)).cast("long"))
    part = F.pmod(F.xxhash64("_id", "_th", F.lit(seed + 1)), F.lit(1 << 20)) / float(1 << 20)
    return fits.unionByName(rest).select(
        F.col("_id").alias("doc_id"), "_th", "source", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce(F.col("full") + F.col("extra"), F.lit(0)).cast("long").alias("passes"),
        F.coalesce((F.col("rank") - 1 + part) / BLOCKS, F.lit(0.0)).alias("slot"))
