"""Corpus pipeline: documents → quality → near duplicates → benchmark passages → secrets → source mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, importance, jaccard, mixing, secrets
from newsloom.llm.common import kept_rows, table, text_key
from newsloom.session import new_path

#: no SQL: the stages sample with Spark's hash, estimate models and scan with automata
ORACLE_SQL = None


def _decided(docs: DataFrame, decisions: DataFrame, keep) -> DataFrame:
    """Rows of ``docs`` that the decisions (doc_id, _th, …) keep."""
    return kept_rows(docs, decisions.select(F.col("doc_id").alias("_id"), "_th", keep.alias("_good")), "_good")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; the others go."""
    return _decided(docs, importance.resample(docs, table(spark, sf_dir, "labels")), F.col("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id (null ids last).

    Documents link when their sets of five-word shingles have a Jaccard similarity of at least 80 %; op9 has its own four words and 85 %.
    Rows without words link with nothing, so all of them stay. Of rows that repeat the kept one a single row stays.
    """
    groups = jaccard.near_components(docs, width=5, percent=80)
    key = lambda i, h: {"_k0": F.coalesce(i, F.lit(0)), "_k1": i.isNull(), "_k2": h}
    best = groups.where("group is not null").groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_th")).alias("m")).select(
        F.col("m.doc_id").alias("doc_id"), F.col("m._th").alias("_th"), F.lit(True).alias("_words"))
    bare = groups.where("group is null").select("doc_id", "_th", F.lit(False).alias("_words")).distinct()
    keep = best.unionByName(bare).select(*[v.alias(k) for k, v in key(F.col("doc_id"), F.col("_th")).items()], "_words")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       *[v.alias(k) for k, v in key(F.col("doc_id").cast("long"), F.xxhash64("text")).items()])
    joined = rows.join(keep, ["_k0", "_k1", "_k2"])
    turn = F.row_number().over(Window.partitionBy("_k0", "_k1", "_k2").orderBy(F.lit(1)))
    return joined.withColumn("_turn", turn).where(~F.col("_words") | (F.col("_turn") == 1)).select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return _decided(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")), ~F.col("contaminated"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in their documents; n_chars follows the new text."""
    return secrets.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, with pass_no (from 0), slot (order within a pass) and source_weight."""
    plan = mixing.mix_sources(docs).where("passes > 0").groupBy(F.col("doc_id").alias("_id"), "_th").agg(
        F.first("passes").alias("_passes"), F.first("slot").alias("slot"), F.first("weight").alias("source_weight"))
    d = docs.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(text_key())])
    p = plan.select(F.col("_id").alias("_i2"), F.col("_th").alias("_t2"), "_passes", "slot", "source_weight")
    joined = d.join(p, d["_k0"].eqNullSafe(p["_i2"]) & (d["_k1"] == p["_t2"]))
    own = ("pass_no", "slot", "source_weight")
    return joined.select(*[d[c] for c in docs.columns if c not in own], F.explode(F.sequence(F.lit(0).cast("long"), F.col("_passes") - 1)).alias("pass_no"),
                         p["slot"], p["source_weight"])


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"corpus-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
