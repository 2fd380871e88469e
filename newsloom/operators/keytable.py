"""A table of known keys beside a parquet table: which of a batch's keys are there, without reading the table.

Keys are kept in segments, one per written batch, merged from time to time. A segment deals its keys by hash into bucket folders of
bounded size and has one Bloom filter for each bucket. A lookup tests the batch's keys against the filters of the buckets they belong to and
reads only the buckets a filter lets through; the keys themselves decide, so a false hit costs a read and nothing else.

A segment carries the name of its batch: when a batch is repeated after a crash, its own segment is left out of the lookup and written anew.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import discard, folder_names

BUCKET_KEYS = 200_000
FILTER_BITS, FILTER_HASHES = 16, 8
MOST_SEGMENTS = 8
FILTER_SCHEMA = "bucket int, buckets int, keys bigint, bits binary"


def _places(h: np.ndarray, size: int) -> np.ndarray:
    """Bit places of each hash in a filter of ``size`` bits: double hashing over the two halves."""
    low, high = (h & np.uint64(0xFFFFFFFF)), (h >> np.uint64(32)) | np.uint64(1)
    step = np.arange(FILTER_HASHES, dtype=np.uint64)
    return ((low[:, None] + step * high[:, None]) % np.uint64(size)).astype(np.int64)


def _filter_of(group: pa.Table) -> pa.Table:
    h = group["h"].to_numpy().view(np.uint64)
    bits = np.zeros(max(64, FILTER_BITS * len(h)), bool)
    bits[_places(h, len(bits)).ravel()] = True
    return pa.table({"bucket": group["bucket"][:1], "buckets": group["buckets"][:1], "keys": pa.array([len(h)], pa.int64()),
                     "bits": pa.array([len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes()], pa.binary())})


def _let_through(keys: pa.Table, filters: pa.Table) -> pa.Table:
    none = pa.table({"segment": pa.array([], pa.string()), "bucket": pa.array([], pa.int32())})
    if not len(keys) or not len(filters):
        return none
    blob = filters["bits"][0].as_py()
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=8))
    places = _places(keys["h"].to_numpy().view(np.uint64), int.from_bytes(blob[:8], "little"))
    hit = bits[places].all(axis=1).any()
    return pa.table({"segment": filters["segment"][:1], "bucket": filters["bucket"][:1]}) if hit else none


class KeyTable:
    """Known keys under ``root`` (one writer at a time)."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)

    def segments(self) -> list[str]:
        """Complete segments: the filters are written last."""
        return [n.removeprefix("segment=") for n in folder_names(self.spark, f"{self.root}/filters", "_SUCCESS")]

    def add(self, rows: DataFrame, segment: str | None = None, count: int | None = None) -> str:
        """Write the distinct keys of ``rows`` as a segment; keys with a null are not kept. Known keys may be added again."""
        name = segment or uuid.uuid4().hex
        distinct = rows.select(*self.keys).dropna().distinct()
        buckets = max(1, math.ceil((distinct.count() if count is None else count) / BUCKET_KEYS))
        dealt = distinct.withColumns({"h": F.xxhash64(*self.keys), "buckets": F.lit(buckets)}).withColumn(
            "bucket", F.pmod("h", F.lit(buckets)).cast("int"))
        path = f"{self.root}/keys/segment={name}"
        dealt.drop("buckets").repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(dealt.drop("buckets").schema).parquet(path).withColumn("buckets", F.lit(buckets))
        written.select("bucket", "buckets", "h").groupBy("bucket").applyInArrow(_filter_of, FILTER_SCHEMA).write.mode(
            "overwrite").parquet(f"{self.root}/filters/segment={name}")
        return name

    def _filters(self, segments: list[str]) -> DataFrame:
        paths = [f"{self.root}/filters/segment={s}" for s in segments]
        schema = StructType.fromDDL(FILTER_SCHEMA + ", segment string")
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/filters").parquet(*paths)

    def lookup(self, rows: DataFrame, without: str | None = None) -> DataFrame | None:
        """The buckets of known keys that may hold keys of ``rows``: a scan of their files alone, or None if no filter lets one through."""
        segments = [s for s in self.segments() if s != without]
        if not segments:
            return None
        filters = self._filters(segments)
        # a few segments, each with a number of buckets of its own
        sizes = filters.groupBy("segment").agg(F.max("buckets").alias("buckets")).collect()
        if not sizes:
            return None
        places = F.array(*[F.struct(F.lit(r.segment).alias("segment"), F.pmod("h", F.lit(r.buckets)).cast("int").alias("bucket")) for r in sizes])
        keys = rows.select(F.xxhash64(*self.keys).alias("h")).distinct().select("h", F.inline(places)).select("segment", "bucket", "h")
        touched = filters.join(keys.select("segment", "bucket").distinct(), ["segment", "bucket"], "left_semi")
        by = ["segment", "bucket"]
        found = keys.groupBy(*by).cogroup(touched.groupBy(*by)).applyInArrow(_let_through, "segment string, bucket int").collect()
        if not found:
            return None
        paths = [f"{self.root}/keys/segment={r.segment}/bucket={r.bucket}" for r in found]
        return self.spark.read.schema(rows.select(*self.keys).schema).parquet(*paths)

    def absent(self, rows: DataFrame, without: str | None = None) -> DataFrame:
        """``rows`` whose keys are not known."""
        known = self.lookup(rows, without)
        return rows if known is None else rows.join(known.distinct(), self.keys, "left_anti")

    def compact(self, without: str | None = None, most: int = MOST_SEGMENTS) -> None:
        """With more than ``most`` segments, merge all but the larger half of them into one."""
        segments = [s for s in self.segments() if s != without]
        if len(segments) <= most:
            return
        sizes = {r.segment: r.n for r in self._filters(segments).groupBy("segment").agg(F.sum("keys").alias("n")).collect()}
        small = sorted(segments, key=lambda s: sizes.get(s, 0))[:len(segments) - most // 2]
        paths = [f"{self.root}/keys/segment={s}" for s in small]
        first = self.spark.read.option("basePath", f"{self.root}/keys").parquet(*paths)
        self.add(first, count=sum(sizes.get(s, 0) for s in small))
        # filters first: without them a segment does not count, so readers never see a half of it
        discard(self.spark, *[f"{self.root}/filters/segment={s}" for s in small], *paths)
