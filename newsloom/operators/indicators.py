"""Indicator series: ordering by period label, changes, tails, chart points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import period_sort_key
from ..functions.numbers import change_pct as change_of
from ..functions.text import strip
from ..scale import attach, packed_arrays, scan_rows, top_n
from ..session import stage

SERIES = "series_key"


def with_period_key(rows: DataFrame) -> DataFrame:
    """Add the series key (lower-case trimmed name) and the sortable period columns p_y, p_m, p_d."""
    k = F.col("_k")
    return rows.withColumns({SERIES: F.lower(strip(F.col("indicator_name"))), "_k": period_sort_key(F.col("period"))}) \
        .withColumns({"p_y": k["y"], "p_m": k["m"], "p_d": k["d"]}).drop("_k")


ORDER = ["p_y", "p_m", "p_d", "row_id"]


def change_pct(rows: DataFrame) -> DataFrame:
    """Add change_pct against the previous period of the same series. Rows need a unique row_id."""
    keyed = with_period_key(rows.drop("change_pct"))
    lagged = scan_rows(keyed, [SERIES], ORDER, lags={"previous": F.col("value")})
    return lagged.withColumn("change_pct", change_of(F.col("value"), F.col("previous"))).drop(
        "previous", SERIES, "p_y", "p_m", "p_d")


def _latest(rows: DataFrame, n: int, key: str) -> DataFrame:
    return top_n(with_period_key(rows), [key], [F.col(c).desc() for c in ORDER], n, "age")


def last_n(rows: DataFrame, n: int, key: str = "indicator_name") -> DataFrame:
    """The most recent ``n`` rows per series, in ascending order per series."""
    return _latest(rows, n, key).orderBy(key, F.col("age").desc()).drop("age", SERIES, "p_y", "p_m", "p_d")


def latest_with_change(rows: DataFrame) -> DataFrame:
    """(indicator_name, period, value, change): last point per series and its change from the one before."""
    two = _latest(rows, 2, "indicator_name")
    last, before = F.col("age") == 1, F.col("age") == 2
    return two.groupBy("indicator_name").agg(
        F.max(F.when(last, F.col("period"))).alias("period"), F.max(F.when(last, F.col("value"))).alias("value"),
        (F.max(F.when(last, F.col("value"))) - F.max(F.when(before, F.col("value")))).alias("change"))


def distinct_names(rows: DataFrame) -> DataFrame:
    return rows.select("indicator_name").distinct().orderBy("indicator_name")


def series_arrays(rows: DataFrame, part_size: int = 10_000) -> DataFrame:
    """(indicator_name, part_no, x, y): chart arrays in period order, long series in several parts."""
    keyed = with_period_key(rows).withColumns({"x": F.col("period"), "y": F.col("value")})
    return packed_arrays(keyed, ["indicator_name"], ORDER, ["x", "y"], part_size)


def downsample(rows: DataFrame, key: str, order: list[str], points: int = 12) -> DataFrame:
    """At most ``points`` rows per series for a chart, as (…, point_no).

    Every n//points-th row from the first on; the last kept one is replaced by the last of the series.
    A series of one row yields it twice.
    """
    pos = scan_rows(rows, [key], order, rank="_pos")
    sizes = stage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    j = attach(pos, sizes, [key], "inner")
    n, i = F.col("_n"), F.col("_pos") - 1
    step = F.greatest(F.lit(1), F.floor(n / points))
    kept = F.least(F.floor((n - 1) / step) + 1, F.lit(points))
    slot = F.floor(i / step)
    regular = (i % step == 0) & (slot < kept - 1)
    last = i == n - 1
    numbers = (F.when(n == 1, F.array(F.lit(0), F.lit(1)))
               .when(n <= points, F.array(i))
               .when(last, F.array(kept - 1))
               .when(regular, F.array(slot)))
    out = j.withColumn("point_no", F.explode(F.transform(numbers, lambda x: x.cast("long"))))
    return out.drop("_pos", "_n")


def daily_series(values: DataFrame, series: str, day: Column, value: Column, fetched_at: Column) -> DataFrame:
    """One row per day of a named series; ``value`` and ``fetched_at`` are aggregates over the day's rows."""
    return values.groupBy(F.to_date(day).alias("period_date")).agg(
        value.alias("value"), fetched_at.alias("fetched_at")).withColumn("series", F.lit(series))
