"""Registry of the driver queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# tables with long texts, whose rows are worth spreading over the cores
TEXT_TABLES = {"documents", "pages", "conversations"}


@dataclass(frozen=True)
class Tables:
    """The driver tables of one scale factor."""

    spark: SparkSession
    root: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        # a table of fewer files than cores (here: one file, one row group) would be read by a single task
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if len(df.inputFiles()) < cores and name in TEXT_TABLES else df


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL."""
    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, root: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, str(root).rstrip("/")))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c: Column, sep: str = "|") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)
