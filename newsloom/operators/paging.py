"""Orders, pages and top-k reports. ``orderBy + limit`` keeps k rows per task before the merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import period_sort_key
from ..scale import top_n


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_news(items: DataFrame, offset: int, limit: int) -> DataFrame:
    """Newest first, undated last; ties by creation time, then id."""
    return page(items, [F.col("published_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("item_id")],
                offset, limit)


def page_sources(sources: DataFrame, offset: int, limit: int, by_failures: bool = False) -> DataFrame:
    first = [F.col("consecutive_failures").desc(), F.col("priority").desc()] if by_failures else \
        [F.col("priority").desc(), F.col("created_at").desc()]
    return page(sources, [*first, F.col("source_id")], offset, limit)


def sort_schedule(schedule: DataFrame, now: Column) -> DataFrame:
    """Due sources first, then by expected time, then by label."""
    return schedule.orderBy(~F.col("is_due"), F.coalesce("next_expected_at", now), "source_label", "source_id")


SEVERITY_RANK = {"critical": 0, "warning": 1}


def alert_order() -> list[Column]:
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return [rank, F.col("code"), F.col("id")]


def sort_alerts(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    out = alerts.orderBy(*alert_order())
    return out if limit is None else out.limit(limit)


def top_due(sources: DataFrame, limit: int = 100) -> DataFrame:
    """Highest priority first, longest waiting first, never fetched before all."""
    return sources.orderBy(F.col("priority").desc(), F.col("last_fetch_at").asc_nulls_first(), "source_id").limit(limit)


def page_indicators(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """By name, then chronologically by period label; the page is cut after the sort."""
    return page(rows, [F.col("indicator_name"), period_sort_key(F.col("period")), F.col("row_id")], offset, limit)


def cap_newest(df: DataFrame, n: int, ts: str, row_id: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc_nulls_last(), row_id).limit(n)


def state_listing(cursors: DataFrame, connector: str, offset: int, limit: int) -> DataFrame:
    """Cursor rows of one connector, most recently fetched first."""
    return page(cursors.where(F.col("connector") == connector),
                [F.col("last_fetch_at").desc_nulls_last(), F.col("source_id")], offset, limit)


def linked_digest(items: DataFrame, by: str, n: int = 20) -> DataFrame:
    """(group, items, digest): a count line and the ``n`` newest titles with links, one text per group."""
    counts = items.groupBy(by).agg(F.count(F.lit(1)).alias("items"))
    newest = top_n(items.select(by, "item_id", "title", "url", "published_at"), [by],
                   [F.col("published_at").desc_nulls_last(), F.col("item_id")], n)
    title = F.replace(F.coalesce("title", F.lit("Без заголовка")), F.lit("\n"), F.lit(" "))
    url = F.trim(F.coalesce("url", F.lit("")))
    line = F.when(url != "", F.concat(F.lit("- ["), title, F.lit("]("), url, F.lit(")"))).otherwise(
        F.concat(F.lit("- "), title))
    lines = newest.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    text = F.concat(F.col(by).cast("string"), F.lit(": "), F.col("items").cast("string"), F.lit(" публикаций.\n\n"),
                    F.array_join(F.col("l.line"), "\n"))
    return counts.join(lines, by).select(by, "items", text.alias("digest"))


def history_window(daily: DataFrame, today: Column, days: int) -> DataFrame:
    """Daily rows of the last ``days`` days, oldest first."""
    return daily.where(F.col("period_date") >= F.date_sub(today, days)).orderBy("series", "period_date")
