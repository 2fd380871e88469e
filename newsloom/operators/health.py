"""Source health from run logs: failure streaks, backoff, alerts, crawl schedule, rate slots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import IDENTITY, attach, order_chunks, rejoin, row_identity, scan, scan_rows
from ..session import stage
from .filters import at
from .paging import sort_alerts, sort_schedule
from .sections import source_label

# Pause in seconds after the 1st, 2nd, … failure in a row; defaults of special cases.
BACKOFF_LADDER = [60, 300, 900, 3600, 21600, 86400]
TOO_MANY_REQUESTS_PAUSE = 60
POLICY_PAUSE = 86400


def backoff_seconds(failures: Column) -> Column:
    return F.element_at(F.lit(BACKOFF_LADDER), F.greatest(F.lit(1), F.least(failures, F.lit(6))).cast("int"))


def pause_seconds(failures: Column, http_status: Column, retry_after: Column, error: Column) -> Column:
    """Pause after a failed run: flood wait, then 429, then policy block, then the ladder."""
    flood = F.regexp_extract(F.coalesce(error, F.lit("")), r"(?i)flood\s*wait\D*(\d+)", 1).try_cast("int")
    blocked = F.coalesce(error, F.lit("")).rlike(r"(?i)blocked by robots|permission")
    return (F.when(flood.isNotNull(), flood)
            .when(http_status == 429, F.coalesce(retry_after, F.lit(TOO_MANY_REQUESTS_PAUSE)))
            .when(blocked, F.lit(POLICY_PAUSE))
            .otherwise(backoff_seconds(failures))).cast("long")


def _until(run_at: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(run_at) + seconds)


def failure_streak(runs: DataFrame) -> DataFrame:
    """Add consecutive_failures after every run (source_id, run_at, run_id, ok)."""
    key, order = ["source_id"], ["run_at", "run_id", *IDENTITY]
    # messages and the like stay out of the staged chunks
    counted = scan(order_chunks(runs.select("source_id", "run_at", "run_id", "ok", *row_identity(runs)), key, order), key, order, rank="_pos")
    filled = scan(counted, key, order, fills={"_last_ok": F.when(F.col("ok"), F.col("_pos"))})
    failures = (F.col("_pos") - F.coalesce("_last_ok", F.lit(0))).cast("int")
    return rejoin(runs, filled.select(*IDENTITY, failures.alias("consecutive_failures")))


def backoff_until(runs: DataFrame) -> DataFrame:
    """Add consecutive_failures and backoff_until after every run; a success clears both."""
    seconds = pause_seconds(F.col("consecutive_failures"), F.col("http_status"), F.col("retry_after"), F.col("error"))
    return failure_streak(runs).withColumn(
        "backoff_until", F.when(~F.col("ok"), _until(F.col("run_at"), seconds)))


def fold_runs(runs: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Health state per source after its runs, continuing from ``state``.

    Only grouped aggregates and one lookup join: the failures after the last success are counted, not
    walked, so a source with a large share of the runs stays spread over the tasks.
    """
    moment = F.struct("run_at", "run_id")
    last_ok = stage(runs.where("ok").groupBy("source_id").agg(F.max(moment).alias("_ok_at")), "last_ok")
    marked = attach(runs, last_ok, ["source_id"])
    after = ~F.col("ok") & (F.col("_ok_at").isNull() | (moment > F.col("_ok_at")))
    folded = marked.groupBy("source_id").agg(
        F.max("run_at").alias("last_fetch_at"), F.max(F.when(F.col("ok"), F.col("run_at"))).alias("last_success_at"),
        F.count_if(after).alias("_fails"),
        F.max_by(F.struct("ok", "run_at", "http_status", "retry_after", "error"), moment).alias("_last"))
    if state is None:
        old = F.lit(0)
        out = folded.withColumn("_old_success", F.lit(None).cast("timestamp"))
    else:
        prior = state.select("source_id", F.col("consecutive_failures").alias("_old"),
                             F.col("last_success_at").alias("_old_success"))
        out, old = folded.join(prior, "source_id", "left"), F.coalesce("_old", F.lit(0))
    fails = F.when(F.col("last_success_at").isNotNull(), F.col("_fails")).otherwise(F.col("_fails") + old)
    out = out.withColumn("consecutive_failures", fails.cast("int"))
    seconds = pause_seconds(F.col("consecutive_failures"), F.col("_last.http_status"), F.col("_last.retry_after"),
                            F.col("_last.error"))
    out = out.select(
        "source_id", "last_fetch_at", F.coalesce("last_success_at", "_old_success").alias("last_success_at"),
        "consecutive_failures",
        F.when(~F.col("_last.ok"), _until(F.col("_last.run_at"), seconds)).alias("backoff_until"),
        F.when(~F.col("_last.ok"), F.col("_last.error")).alias("last_error"))
    if state is None:
        return out
    return out.unionByName(state.select(*out.columns).join(out.select("source_id"), "source_id", "left_anti"))


def _whole_minutes(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 60_000_000).cast("long")


def source_alerts(sources: DataFrame, now: dt.datetime, limit: int | None = None) -> DataFrame:
    """Up to three alerts per enabled source, most severe first."""
    clock = at(now)
    failures = F.coalesce("consecutive_failures", F.lit(0)).cast("long")
    freq = F.greatest(F.lit(1), F.coalesce("fetch_frequency_min", F.lit(60)))
    stale = F.greatest(F.lit(180), freq * 2).cast("long")
    left = _whole_minutes(F.col("backoff_until"), clock)
    since_fetch = F.coalesce(_whole_minutes(clock, F.col("last_fetch_at")), F.lit(0))
    since_ok = _whole_minutes(clock, F.col("last_success_at"))
    sid = F.col("source_id").cast("string")

    def alert(prefix: str, severity, code: str, **meta: Column) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        entries = [x for k, v in meta.items() for x in (F.lit(k), v)]
        facts = F.create_map(*entries) if entries else F.expr("cast(map() as map<string,bigint>)")
        return F.struct(F.concat(F.lit(prefix + ":"), sid).alias("id"), level.alias("severity"),
                        F.lit(code).alias("code"), facts.alias("meta"))

    failing = (F.when(failures >= 3, alert("fail-critical", "critical", "SOURCE_CONSECUTIVE_FAILURES_HIGH",
                                           consecutive_failures=failures))
               .when(failures > 0, alert("fail-warning", "warning", "SOURCE_CONSECUTIVE_FAILURES",
                                         consecutive_failures=failures)))
    paused = F.when(F.col("backoff_until") > clock, alert(
        "backoff", F.when(left >= 360, "critical").otherwise("warning"), "SOURCE_BACKOFF_ACTIVE",
        backoff_minutes_left=F.greatest(F.lit(0), left)))
    silent = (F.when(F.col("last_success_at").isNull() & F.col("last_fetch_at").isNull(),
                     alert("never-run", "warning", "SOURCE_NEVER_RUN"))
              .when(F.col("last_success_at").isNull() & (since_fetch >= stale),
                    alert("never-success", "critical", "SOURCE_NEVER_SUCCEEDED", minutes_since_last_fetch=since_fetch))
              .when(since_ok >= stale, alert(
                  "stale", F.when(since_ok >= stale * 2, "critical").otherwise("warning"), "SOURCE_STALE_SUCCESS",
                  minutes_since_success=since_ok, stale_threshold_min=stale)))
    rows = sources.where("enabled").select(
        "source_id", source_label().alias("source_label"),
        F.explode(F.array_compact(F.array(failing, paused, silent))).alias("a"))
    flat = rows.select("a.id", "a.severity", "a.code", "source_id", "source_label", "a.meta")
    return sort_alerts(flat, limit)


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("critical", "warning", "info")])


def crawl_schedule(sources: DataFrame, now: dt.datetime, include_disabled: bool = False) -> DataFrame:
    """When each source is expected to be fetched next, due ones first."""
    clock = at(now)
    freq = F.coalesce("fetch_frequency_min", F.lit(60)).cast("long")
    nxt = F.coalesce(F.timestamp_micros(F.unix_micros("last_fetch_at") + freq * 60_000_000), clock)
    blocked = F.coalesce(F.col("backoff_until") > clock, F.lit(False))
    due = F.col("enabled") & (nxt <= clock) & ~blocked
    expected = (F.when(~F.col("enabled"), F.lit(None).cast("timestamp")).when(due, clock)
                .when(blocked, F.greatest("backoff_until", nxt)).otherwise(nxt))
    rows = sources if include_disabled else sources.where("enabled")
    return sort_schedule(rows.select(
        "source_id", source_label().alias("source_label"), "enabled", freq.alias("fetch_frequency_min"),
        due.alias("is_due"), expected.alias("next_expected_at")), clock)


def health_overview(sources: DataFrame, now: dt.datetime) -> DataFrame:
    """One row: alerts by severity and the number of due sources."""
    counts = severity_counts(source_alerts(sources, now)).select(
        F.lit(1).alias("k"), "critical_count", "warning_count")
    due = crawl_schedule(sources, now).agg(F.count_if("is_due").alias("due_count")).withColumn("k", F.lit(1))
    return counts.join(due, "k").drop("k")


def rate_slots(requests: DataFrame, scope: str, max_per_min: int) -> DataFrame:
    """Add slot_no, admitted and run_at for requests (request_id, ts): at most ``max_per_min`` per scope and minute.

    Later ones wait for the next minute; a limit of zero or less admits everything.
    """
    minute = requests.withColumn("minute", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 60) * 60))
    keys, order = [scope, "minute"], ["ts", "request_id"]
    numbered = scan_rows(minute, keys, order, rank="slot_no")
    admitted = (F.col("slot_no") <= max_per_min) if max_per_min > 0 else F.lit(True)
    following = F.timestamp_seconds(F.unix_seconds("minute") + 60)
    return numbered.withColumns({"admitted": admitted, "run_at": F.when(admitted, F.col("ts")).otherwise(following)})


def domain_limit(source_limit: int) -> int:
    """A whole domain may always take 30 requests a minute."""
    return max(30, source_limit)
