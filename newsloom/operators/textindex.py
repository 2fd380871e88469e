"""Trigram postings beside a parquet table: which of its files may hold a text that fits an ``ilike`` pattern.

A file's distinct trigrams of case-folded text are listed once for each file, in buckets by trigram. A search takes the trigrams of the
pattern's literal stretches, reads their buckets, keeps the files that have all of them, and lets ``ilike`` verify the rows of these files alone.
The postings grow with files × distinct trigrams, not with the text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import table_exists

BUCKETS = 64
#: a task sends a file's trigrams when it holds so many, so memory stays bounded on odd alphabets
HELD = 500_000


def trigrams(text: str) -> set[str]:
    return {text[i:i + 3] for i in range(len(text) - 2)}


def literal_runs(pattern: str) -> list[str]:
    """Stretches of a like pattern without wildcards; a backslash makes the next character literal."""
    runs = [""]
    for token in re.findall(r"\\.|.", pattern, re.S):
        if token in ("%", "_"):
            runs.append("")
        else:
            runs[-1] += token[-1]
    return [r for r in runs if r]


def _place(path: str) -> str:
    """A file's address without the ways in which Spark writes it differently."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(path))


def _posted(batches):
    held: dict[str, set] = {}

    def out(files):
        rows = [(f, t) for f in files for t in held.pop(f)]
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], names=["file", "trigram"])

    for batch in batches:
        for file, texts in zip(batch["file"].to_pylist(), batch["texts"].to_pylist()):
            mine = held.setdefault(file, set())
            for text in texts:
                mine.update(trigrams(text or ""))
            if len(mine) > HELD or len(held) > 100:
                yield out(list(held))
    if held:
        yield out(list(held))


class TextIndex:
    """Postings under ``root`` for some text columns of the parquet table at ``table``."""

    def __init__(self, spark: SparkSession, table: str, root: str, columns: Sequence[str]):
        self.spark, self.table, self.root, self.columns = spark, table, root, list(columns)

    def build(self) -> None:
        """Index the table's files that are not indexed yet; files of a parquet table don't change."""
        rows = self.spark.read.parquet(self.table).select(F.col("_metadata.file_path").alias("file"), F.array(*[F.lower(c) for c in self.columns]).alias("texts"))
        if table_exists(self.spark, f"{self.root}/files"):
            done = self.spark.read.parquet(f"{self.root}/files")
            rows = rows.join(F.broadcast(done.distinct()), "file", "left_anti")  # one row per file
            if rows.isEmpty():
                return
        posted = rows.mapInArrow(_posted, "file string, trigram string").distinct()
        dealt = posted.withColumn("bucket", F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int"))
        dealt.repartition("bucket").sortWithinPartitions("bucket", "trigram").write.mode("append").partitionBy("bucket").parquet(f"{self.root}/postings")
        # listed last: a build that broke off is done again, and postings may be repeated
        rows.select("file").distinct().write.mode("append").parquet(f"{self.root}/files")

    def files(self, pattern: str) -> list[str]:
        """Files that may hold a fitting text: those with all trigrams of the pattern, and those not indexed yet."""
        every = {_place(f): f for f in self.spark.read.parquet(self.table).inputFiles()}
        low = self.spark.range(1).select(*[F.lower(F.lit(r)).alias(f"r{i}") for i, r in enumerate(literal_runs(pattern))]).first()
        wanted = sorted(set().union(*[trigrams(r) for r in low])) if low else []
        if not wanted or not table_exists(self.spark, f"{self.root}/files"):
            return sorted(every.values())
        known = {_place(r.file) for r in self.spark.read.parquet(f"{self.root}/files").collect()}
        places = self.spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in wanted])).alias("w")).select(
            F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()
        postings = self.spark.read.parquet(f"{self.root}/postings").where(F.col("bucket").isin([r.b for r in places]) & F.col("trigram").isin(wanted))
        full = postings.groupBy("file").agg(F.countDistinct("trigram").alias("n")).where(F.col("n") == len(wanted))
        good = {_place(r.file) for r in full.select("file").collect()}
        return sorted(f for p, f in every.items() if p in good or p not in known)

    def search(self, pattern: str) -> DataFrame:
        """Rows of the table with a column that fits ``pattern``, case ignored; only candidate files are scanned."""
        found = self.files(pattern)
        whole = self.spark.read.parquet(self.table)
        rows = self.spark.read.schema(whole.schema).option("basePath", self.table).parquet(*found) if found else whole.limit(0)
        fits = F.lit(False)
        for c in self.columns:
            fits = fits | F.coalesce(F.ilike(F.col(c), F.lit(pattern)), F.lit(False))
        return rows.where(fits)
