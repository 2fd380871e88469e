"""Exchange quotes from column-oriented JSON answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOSCOW = "Europe/Moscow"
BLOCK = "marketdata struct<columns:array<string>,data:array<array<string>>>"


def quote_rows(payloads: DataFrame, today: Column | None = None) -> DataFrame:
    """First data row of each answer (source_id, body, fetched_at) as a daily value.

    (source_id, secid, period_date, value, waprice, updated_at, error): LAST, else the weighted average price;
    with neither the row carries an error and no value. Dates and times are those of the exchange.
    """
    p = payloads.select("source_id", "fetched_at", F.from_json("body", BLOCK).alias("x"))
    columns, row = F.col("x.marketdata.columns"), F.get("x.marketdata.data", F.lit(0))
    width = F.least(F.size(columns), F.size(row))
    cells = F.map_from_arrays(F.slice(columns, 1, F.greatest(width, F.lit(0))), F.slice(row, 1, F.greatest(width, F.lit(0))))
    p = p.withColumn("m", F.when(row.isNotNull() & columns.isNotNull(), cells))

    def cell(name: str) -> Column:
        return F.try_element_at(F.col("m"), F.lit(name))

    day = today if today is not None else F.to_date(F.from_utc_timestamp("fetched_at", MOSCOW))
    last, average = cell("LAST").try_cast("double"), cell("WAPRICE").try_cast("double")
    clock = F.when(cell("UPDATETIME").rlike(r"^\s*\d{2}:\d{2}(:\d{2})?\s*$"),
                   F.to_utc_timestamp(F.concat_ws(" ", day.cast("string"), F.trim(cell("UPDATETIME"))).try_cast("timestamp"), MOSCOW))
    value = F.coalesce(last, average)
    error = F.when(F.col("m").isNull(), F.lit("marketdata is empty")).when(value.isNull(), F.lit("no LAST or WAPRICE"))
    return p.select("source_id", F.coalesce(cell("SECID"), F.lit("CNYRUB_TOM")).alias("secid"), day.alias("period_date"),
                    value.alias("value"), average.alias("waprice"), clock.alias("updated_at"), error.alias("error"))
