"""Writes: insert-if-absent, upsert, batch append, report tables, purges."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import period_month
from ..scale import keep_first, keep_last
from ..session import discard, folder_names, new_path, stage
from .keytable import KeyTable

dedup_keep_first = keep_first


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The batch rows to append: first row per key, keys already in ``target`` left out.

    The batch collapses to one row per key before the anti join, so the join sees no hot key.
    """
    return keep_first(batch, keys, order).join(target.select(*keys), list(keys), "left_anti")


def append_new(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str],
               partition_by: Sequence[str] = (), batch_id: str | None = None) -> int:
    """Append the absent rows of ``batch`` to the parquet table at ``path`` (one writer at a time); returns their number.

    Known keys stand in a ``KeyTable`` beside the table, at ``path``_keys. The rows go to a folder ``ingest_batch=…``; with a
    ``batch_id`` a repeated batch replaces its own rows and keys: rows are written first, keys last, so a crash in between is mended by
    the repetition. Keys with a null are never known. A table that was not made here gets a key table, keeps its own
    folders, and takes the rows of a batch that is repeated after such a crash twice.
    """
    name = batch_id or uuid.uuid4().hex
    known = KeyTable(spark, f"{path}_keys", keys)
    foreign = table_exists(spark, path) and not any(n.startswith("ingest_batch=") for n in folder_names(spark, path))
    if foreign and not known.segments():
        known.add(spark.read.parquet(path))
    own = None if foreign else name
    known.compact(without=own)
    fresh, written, staged = known.absent(keep_first(batch, keys, order), without=own), Observation(), new_path(spark, "fresh")
    fresh = fresh.observe(written, F.count(F.lit(1)).alias("rows"))
    if foreign:
        fresh = stage(fresh, "fresh", path=staged)
        fresh.write.mode("append").partitionBy(*partition_by).parquet(path)
    else:
        kept = f"{path}/ingest_batch={name}"
        fresh.write.mode("overwrite").partitionBy(*partition_by).parquet(kept)
        fresh = spark.read.schema(batch.schema).parquet(kept)
    rows = written.get["rows"]
    known.add(fresh, name if own else None, rows)
    if foreign:
        discard(spark, staged)
    return rows


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Target with the batch merged in: per key the row with the highest ``version``, the batch on ties."""
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return keep_last(both, keys, [version, "_new"]).drop("_new")


def touched_partitions(target: DataFrame, batch: DataFrame, partition: str) -> DataFrame:
    """Target rows in the partitions the batch writes to: the part an upsert has to rewrite."""
    return target.join(batch.select(partition).distinct(), partition, "left_semi")


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], version: str,
                 partition: str) -> None:
    """Rewrite only the touched partitions of a partitioned parquet table.

    The table keeps its columns: those the batch lacks stay as they were for known keys and are null for new ones; columns
    that the table doesn't have are refused.
    """
    if table_exists(spark, path):
        target = spark.read.parquet(path)
        new = [c for c in batch.columns if c not in target.columns]
        if new:
            raise ValueError(f"the table at {path} has no columns {new}")
        old = touched_partitions(target, batch, partition)
        lacking = [c for c in target.columns if c not in batch.columns]
        merged = upsert(old.select(*batch.columns), batch, keys, version)
        if lacking:
            merged = merged.join(keep_last(old.select(*keys, version, *lacking), keys, [version]).drop(version), list(keys), "left")
        batch = merged.select(*target.columns)
    else:
        batch = keep_last(batch, keys, [version])
    (stage(batch, "upsert").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def append_batch(rows: DataFrame, source_name: str, batch_id: str | None = None) -> DataFrame:
    """Rows marked with one import batch id and the name of their source."""
    return rows.withColumns({"source_name": F.lit(source_name), "import_batch_id": F.lit(batch_id or str(uuid.uuid4()))})


def write_report_tables(sections: DataFrame, root: str, title: str, date_from: dt.date, date_to: dt.date,
                        created_at: dt.datetime, report_id: str | None = None) -> str:
    """Store the section rows of one report and its metadata row; returns the report id."""
    rid = report_id or uuid.uuid4().hex[:12]
    spark = sections.sparkSession
    sections.withColumn("report_id", F.lit(rid)).write.mode("append").partitionBy("report_id").parquet(f"{root}/sections")
    meta = spark.createDataFrame([(rid, title, date_from, date_to, created_at)],
                                 "id string, title string, date_from date, date_to date, created_at timestamp")
    meta.write.mode("append").parquet(f"{root}/reports")
    return rid


def approved_scopes(summaries: DataFrame, scope: str) -> DataFrame:
    """Scopes whose latest summary is approved."""
    latest = summaries.groupBy(scope).agg(F.max_by("status", F.struct("created_at", "summary_id")).alias("status"))
    return latest.where("status = 'approved'").select(scope)


def purge_scope(posts: DataFrame, summaries: DataFrame, scope: str, wanted: Column | None = None) -> DataFrame:
    """Posts that stay when the posts of all approved scopes (that satisfy ``wanted``) are deleted."""
    gone = approved_scopes(summaries, scope)
    return posts.join(gone.where(wanted) if wanted is not None else gone, scope, "left_anti")


def reset_cursors(profiles: DataFrame, summaries: DataFrame, scope: str) -> DataFrame:
    """Profiles with the cursors of purged scopes set back to the start."""
    gone = approved_scopes(summaries, scope).withColumn("_gone", F.lit(True))
    out = profiles.join(gone, scope, "left")
    return out.withColumns({
        "last_message_id": F.when(F.col("_gone"), F.lit(0)).otherwise(F.col("last_message_id")),
        "backfill_complete": F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("backfill_complete")),
    }).drop("_gone")


def backfill_period_month(items: DataFrame) -> DataFrame:
    """Fill a missing period_month from the publication time, else from the creation time."""
    return items.withColumn("period_month", F.coalesce(
        "period_month", period_month(F.col("published_at"), F.col("created_at"))))
