"""A partitioned parquet table whose partitions are rewritten under new versions and switched by one manifest.

Rows lie in folders ``data/version=…/<partition>=…``; a manifest lists the folders that make up the table. Writing a manifest is the last
step of a change, and a manifest counts only when it is complete: after a failure before that, readers still see the table as it was, and a
reader that began with the older manifest finds all of its folders.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import discard, folder_names
from .sinks import approved_scopes

ENTRIES = "partition_value string, folder string"


class VersionedTable:
    """The table at ``root``, partitioned by one column (one writer at a time)."""

    def __init__(self, spark: SparkSession, root: str, partition: str, schema: StructType):
        self.spark, self.root, self.partition, self.schema = spark, root.rstrip("/"), partition, schema

    def versions(self) -> list[int]:
        return sorted(int(n.removeprefix("version=")) for n in folder_names(self.spark, f"{self.root}/manifest", "_SUCCESS"))

    def entries(self, version: int | None = None) -> dict[str, str]:
        """Partition value → folder."""
        known = self.versions()
        if not known:
            return {}
        rows = self.spark.read.schema(ENTRIES).parquet(f"{self.root}/manifest/version={known[-1] if version is None else version}").collect()
        return {r.partition_value: r.folder for r in rows}

    def read(self, version: int | None = None, values: list[str] | None = None) -> DataFrame:
        found = self.entries(version)
        folders = [f for v, f in found.items() if values is None or v in values]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.root}/data").parquet(*folders)
        return rows.select(*self.schema.names)

    def write(self, rows: DataFrame, replaced: list[str] | None = None) -> int:
        """A new version: ``rows`` instead of the partitions ``replaced`` (None: of all), the others as they are."""
        known = self.versions()
        version = known[-1] + 1 if known else 0
        path = f"{self.root}/data/version={version}"
        rows.select(*self.schema.names).write.mode("overwrite").partitionBy(self.partition).parquet(path)
        kept = {} if replaced is None else {v: f for v, f in self.entries().items() if v not in replaced}
        # folder names carry the values with odd characters escaped
        fresh = {unquote(n.split("=", 1)[1]): f"{path}/{n}" for n in folder_names(self.spark, path) if n.startswith(f"{self.partition}=")}
        self._switch(version, {**kept, **fresh})
        return version

    def _switch(self, version: int, entries: dict[str, str]) -> None:
        listed = self.spark.createDataFrame(sorted(entries.items()), ENTRIES)
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the newest ``keep`` manifests, and the folders that none of the others lists."""
        old, new = self.versions()[:-keep], self.versions()[-keep:]
        used = {f for v in new for f in self.entries(v).values()}
        dead = {f for v in old for f in self.entries(v).values()} - used
        discard(self.spark, *[f"{self.root}/manifest/version={v}" for v in old], *dead)


def purge_table(table: VersionedTable, summaries: DataFrame, scope: str) -> list[str]:
    """Delete the rows of all approved scopes; only partitions that hold such rows are rewritten, in one new version. Returns them."""
    gone = approved_scopes(summaries, scope)
    touched = [r.v for r in table.read().join(gone, scope, "left_semi").select(F.col(table.partition).cast("string").alias("v")).distinct().collect()]
    touched = ["__HIVE_DEFAULT_PARTITION__" if v is None else v for v in touched]
    if touched:
        table.write(table.read(values=touched).join(gone, scope, "left_anti"), touched)
    return touched
