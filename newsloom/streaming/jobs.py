"""Structured Streaming jobs: ingest, de-duplication, cursors, health and rates.

Every job takes a streaming DataFrame and a target folder, keeps its checkpoint next to the target, and
writes per micro-batch with the batch operators, so batch and stream give the same rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import not_before
from ..operators.health import fold_runs
from ..operators.posts import cursor_max
from ..operators.sinks import append_new, table_exists
from ..scale import attach, keep_last, ranked, top_n
from ..session import discard, folder_names, new_path, stage


def start(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Run everything available through ``write`` and stop; a scheduler repeats it, the checkpoint continues it."""
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


RUN_SCHEMA = "batch_id string, fetched long, matched long, inserted long, skipped long, truncated long"


def batch_name(spark: SparkSession, version: int) -> str:
    """Names a micro-batch: the same when it is repeated, another one for another stream into the same target."""
    return f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or 'batch'}-{version}"


def run_log(spark: SparkSession, target: str) -> DataFrame:
    """One row of statistics per micro-batch of ``stream_ingest``."""
    if not table_exists(spark, f"{target}/runs"):
        return spark.createDataFrame([], RUN_SCHEMA)
    return spark.read.schema(RUN_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{target}/runs")


def stream_ingest(payloads: DataFrame, target: str, prepare: Callable[[DataFrame], DataFrame],
                  keys: Sequence[str] = ("canonical_url",), order: Sequence[str] = ("fetched_at", "url"),
                  partition_by: Sequence[str] = ("period_month",)) -> StreamingQuery:
    """Parse and enrich payloads (``prepare``) and append the items whose keys the table does not hold yet.

    Each micro-batch leaves one row in ``runs``: batch_id, fetched, matched, inserted, skipped, truncated (``run_log``), observed
    while its rows are written.
    """
    def write(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        came, left = Observation(), Observation()
        path = new_path(spark, "ingest")
        payload = batch.observe(came, F.count(F.lit(1)).alias("fetched"))
        ready = prepare(payload)
        cut = F.count_if(F.coalesce(F.col("left_out"), F.lit(0)) > 0) if "left_out" in ready.columns else F.count_if(F.lit(False))
        items = stage(ready.observe(left, F.count(F.lit(1)).alias("matched"), cut.alias("truncated")), "ingest", path=path)
        name = batch_name(spark, version)
        inserted = append_new(spark, f"{target}/items", items, keys, order, partition_by, name)
        seen = {**came.get, **left.get, "inserted": inserted}
        row = (name, seen["fetched"], seen["matched"], inserted, seen["matched"] - inserted, seen["truncated"])
        spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{target}/runs/{name}")
        discard(spark, path)

    return start(payloads, f"{target}/_checkpoint", write)


def stream_dedup(rows: DataFrame, target: str, keys: Sequence[str], event_time: str) -> StreamingQuery:
    """First arrived row per key for ever; within a micro-batch the one with the lowest ``event_time``.

    The table itself is the memory, so a new key is kept however old its event time, and a repeated batch adds nothing.
    """
    def write(batch: DataFrame, version: int) -> None:
        spark, path = batch.sparkSession, new_path(batch.sparkSession, "dedup")
        append_new(spark, f"{target}/rows", stage(batch, "dedup", path=path), keys, [event_time], batch_id=batch_name(spark, version))
        discard(spark, path)

    return start(rows, f"{target}/_checkpoint", write)


# --- versioned state tables --------------------------------------------------------------------------
#
# A batch writes what changed, as ``delta=<version>``; every COMPACT_AFTER deltas they are folded into a complete ``v=<version>``. Readers
# merge the newest complete version with the deltas after it. The complete version before and its deltas stay, so that a
# repeated batch finds the state it started from; older ones are deleted.

COMPACT_AFTER = 10
STATE_KEY = "_state_key"


def _state_versions(spark: SparkSession, target: str) -> tuple[list[int], list[int]]:
    """Finished complete versions and deltas."""
    names = folder_names(spark, f"{target}/state", "_SUCCESS")
    numbers = lambda kind: sorted(int(n.removeprefix(kind)) for n in names if n.startswith(kind))
    return numbers("v="), numbers("delta=")


def _state(spark: SparkSession, target: str, base: int | None, deltas: list[int]) -> DataFrame | None:
    """A complete version with deltas merged in, keys included."""
    parts = [(base, f"{target}/state/v={base}")] if base is not None else []
    parts += [(v, f"{target}/state/delta={v}") for v in deltas]
    out = None
    for version, path in parts:
        part = spark.read.parquet(path).withColumn("_version", F.lit(version))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return None
    return (keep_last(out, [STATE_KEY], ["_version"]) if deltas else out).drop("_version")


def read_state(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """Latest state of a table (only from versions below ``before`` for a repeated batch)."""
    bases, deltas = ([v for v in found if before is None or v < before] for found in _state_versions(spark, target))
    base = bases[-1] if bases else None
    state = _state(spark, target, base, [v for v in deltas if base is None or v > base])
    return None if state is None else state.drop(STATE_KEY)


def _write_state(state: DataFrame, target: str, version: int) -> None:
    # a repeated batch overwrites its own version, so a restart gives the same state
    state.write.mode("overwrite").parquet(f"{target}/state/v={version}")


def write_changes(changed: DataFrame, target: str, version: int, keys: Sequence[str], compact_after: int = COMPACT_AFTER) -> None:
    """Write the changed rows of a state, one for each of ``keys``, as the delta of a batch; fold the deltas from time to time."""
    spark = changed.sparkSession
    named = changed.withColumn(STATE_KEY, F.to_json(F.struct(*keys)))
    named.write.mode("overwrite").parquet(f"{target}/state/delta={version}")
    bases, deltas = _state_versions(spark, target)
    base = max((v for v in bases if v < version), default=None)
    since = [v for v in deltas if v <= version and (base is None or v > base)]
    if len(since) > compact_after:
        _state(spark, target, base, since).write.mode("overwrite").parquet(f"{target}/state/v={version}")
        if base is not None:  # what the version before was made of
            discard(spark, *[f"{target}/state/v={v}" for v in bases if v < base], *[f"{target}/state/delta={v}" for v in deltas if v <= base])


def stream_cursor(rows: DataFrame, target: str, by: str, value: str) -> StreamingQuery:
    """Highest id per source seen so far, as a versioned state table."""
    def write(batch: DataFrame, version: int) -> None:
        new = cursor_max(batch, by, value)
        old = read_state(batch.sparkSession, target, version)
        if old is not None:  # cursors of the batch's sources alone
            old = old.join(new.select(by), by, "left_semi")
            new = cursor_max(new.unionByName(old).withColumnRenamed("cursor", value), by, value)
        write_changes(new, target, version, [by])

    return start(rows, f"{target}/_checkpoint", write)


def stream_health(runs: DataFrame, target: str) -> StreamingQuery:
    """Failure counters and backoff per source, folded batch by batch over the versioned state.

    Runs of a source must arrive in order across batches (a run log does); within a batch any order will do.
    """
    def write(batch: DataFrame, version: int) -> None:
        rows = stage(batch, "runs")
        if not rows.isEmpty():
            state = read_state(batch.sparkSession, target, version)
            if state is not None:  # states of the batch's sources alone
                state = state.join(rows.select("source_id").distinct(), "source_id", "left_semi")
            write_changes(fold_runs(rows, state), target, version, ["source_id"])

    return start(runs, f"{target}/_checkpoint", write)


def stream_rate(requests: DataFrame, scope: str, delay: str = "5 minutes") -> DataFrame:
    """Requests per scope and minute as a watermarked tumbling count (scope, minute, requests)."""
    counted = requests.withWatermark("ts", delay).groupBy(scope, F.window("ts", "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("requests"))
    return counted.select(scope, F.col("w.start").alias("minute"), "requests")


def late_policy(rows: DataFrame, target: str, event_time: str, overlap_hours: int = 48) -> StreamingQuery:
    """Append rows that are at most ``overlap_hours`` older than the newest event of the micro-batches before.

    The newest event time is a versioned state table; a repeated batch sees the version before it and rewrites its own rows.
    Rows without an event time are accepted.
    """
    def write(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        arrived = stage(batch, "late")
        old = read_state(spark, target, version)
        newest = old.first()["newest"] if old is not None else None
        fresh = arrived if newest is None else arrived.where(
            F.col(event_time).isNull() | (F.col(event_time) >= F.lit(newest) - F.expr(f"make_interval(0, 0, 0, 0, {int(overlap_hours)})")))
        fresh.write.mode("overwrite").parquet(f"{target}/rows/batch={version}")
        seen = arrived.agg(F.max(event_time).alias("newest"))
        if newest is not None:
            seen = seen.select(F.greatest("newest", F.lit(newest)).alias("newest"))
        _write_state(seen, target, version)

    return start(rows, f"{target}/_checkpoint", write)


def run_to_table(df: DataFrame, target: str, mode: str = "complete") -> DataFrame:
    """Run a stateful stream over everything available and return its result table.

    ``complete`` keeps one version per batch and returns the last; ``append`` collects the rows, one folder per batch, so that
    a repeated batch replaces its own.
    """
    def write(batch: DataFrame, version: int) -> None:
        if mode == "complete":
            _write_state(batch, target, version)
        else:
            batch.write.mode("overwrite").parquet(f"{target}/rows/batch={version}")

    start(df, f"{target}/_checkpoint", write, mode).awaitTermination()
    spark = df.sparkSession
    if mode == "complete":
        return read_state(spark, target)
    return appended_rows(spark, target, df.schema)


def appended_rows(spark: SparkSession, target: str, schema) -> DataFrame:
    """All rows of a target with one folder per batch."""
    if not table_exists(spark, f"{target}/rows"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{target}/rows")


def backfill(messages: DataFrame, until: dt.date, page_size: int = 500) -> tuple[DataFrame, DataFrame]:
    """(kept, status) of a channel history (channel, message_id, published_at), paged backwards until a date.

    Pages of ``page_size`` messages are read newest first; reading stops with the page that reaches back before ``until`` or is not full.
    ``kept`` are the messages of the whole history from ``until`` on and undated ones, with ``in_pages``: do the pages read hold them?
    The status of a channel has the number of pages read, whether they reach back before the date, how many kept messages they hold (``kept``), and
    of the whole history the newest and oldest message and the number of kept ones (``wanted``). All pages are numbered at once; a null channel is a
    channel of its own.
    """
    order = {"_undated": F.col("message_id").isNull(), "_back": -F.col("message_id")}
    numbered = ranked(messages.withColumns(order), ["channel"], list(order), "_no").drop(*order)
    # a struct is never null, so joins find the null channel too
    paged = numbered.withColumns({"_channel": F.struct("channel"), "_page": F.floor((F.col("_no") - 1) / page_size)}).drop("_no")
    old = F.coalesce(F.to_date("published_at") < F.lit(until), F.lit(False))
    pages = stage(paged.groupBy("_channel", "_page").agg(
        F.max(old).alias("old"), F.count(F.lit(1)).alias("n"), F.count_if(~old).alias("new"), F.max("message_id").alias("newest"),
        F.min("message_id").alias("oldest"), F.min("published_at").alias("oldest_at")), "pages")
    ends = pages.groupBy("_channel").agg(
        F.coalesce(F.min(F.when(F.col("old") | (F.col("n") < page_size), F.col("_page"))), F.max("_page")).alias("_last"),
        F.max("newest").alias("last_message_id"), F.min("oldest").alias("first_message_id"), F.min("oldest_at").alias("oldest_at"),
        F.max("old").alias("reached_until"), F.sum("new").alias("wanted"))
    read = attach(pages.select("_channel", "_page", "new"), ends.select("_channel", "_last"), ["_channel"]).where(F.col("_page") <= F.col("_last"))
    wanted, _ = not_before(paged, until, "channel")
    marks = read.select("_channel", "_page", F.lit(True).alias("_read"))
    kept = wanted.join(marks, ["_channel", "_page"], "left").withColumn("in_pages", F.coalesce("_read", F.lit(False))).drop("_channel", "_page", "_read")
    status = ends.join(read.groupBy("_channel").agg(F.sum("new").alias("kept")), "_channel").select(
        F.col("_channel.channel").alias("channel"), (F.col("_last") + 1).alias("pages"), "reached_until", "kept", "wanted", "last_message_id",
        "first_message_id", "oldest_at")
    return kept, status


def recheck_tail(messages: DataFrame, by: str, row_id: str, window: int = 50) -> DataFrame:
    """The newest ``window`` messages per channel, read again to catch edits."""
    return top_n(messages, [by], [F.col(row_id).desc()], window).drop("rank")
