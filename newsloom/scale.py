"""Building blocks that keep their cost even when one key holds a large share of the rows.

* ``keep_first`` / ``keep_last``: one row per key by an aggregate with map-side combine, no window.
* ``top_n``: n rows per key; Spark limits each key before the shuffle (WindowGroupLimit).
* ``order_chunks`` + ``scan``: running sums, ranks, lags and forward fills over one ordered key,
  computed per range-partitioned chunk and stitched by one summary row per (key, chunk).
* ``scan_rows``: the same over wide rows, of which only key, order and used values are staged.
* ``row_identity`` + ``rejoin``: results of narrow staged columns brought back to the rows they came from.
* ``packed_arrays``: ordered arrays of bounded length instead of one array per key.
* ``attach``: lookup join that broadcasts a measured small side and salts the shuffle otherwise.
* ``attach_counted``: lookup join for keys whose row counts are known: hot keys apart from the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .session import discard, new_path, stage

CHUNK = "_chunk"
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16
GROUP_LIMIT_MAX = 1000
#: rows of one key that a task orders at a time
CHUNK_ROWS = 1_000_000
#: types whose values are of fixed size
NARROW = ("int", "bigint", "smallint", "tinyint", "double", "float", "date", "timestamp", "boolean", "decimal")


def _ascending(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in ``order`` (ascending, nulls first)."""
    return _pick(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Last row per key in ``order`` (ascending, nulls first)."""
    return _pick(df, keys, order, F.max_by)


def _pick(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    # a struct is never null, so null order values are ranked instead of skipped
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_ascending(order))])
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(pick(row, rank).alias("_row"))
    return picked.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest]).select(*df.columns)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key; ``order`` must be total (end with an id)."""
    if n > GROUP_LIMIT_MAX:
        # beyond Spark's own per-key limit: cut inside salted sub-groups first
        plain = [c for c, t in df.dtypes if not t.startswith("map")]
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS * 8)))
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def order_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Range-partition by key and order and tag each row with its partition as ``_chunk``.

    The result is staged, so the tags stay the same however often it is read. ``order`` must be
    total; then no chunk grows with the size of a single key. Rows are counted while they are written: if there are more than
    ``CHUNK_ROWS`` / 2 for each of the session's shuffle partitions, they are dealt anew to as many ranges as that takes.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ranged(rows: DataFrame, n: int, path: str) -> tuple[DataFrame, int]:
        seen = Observation()
        dealt = rows.repartitionByRange(n, *[F.col(k) for k in keys], *_ascending(order)).withColumn(CHUNK, F.spark_partition_id())
        return stage(dealt.observe(seen, F.count(F.lit(1)).alias("n")), "chunks", path=path), seen.get["n"]

    path = new_path(spark, "chunks")
    out, rows = ranged(df, parts, path)
    wanted = -(-2 * rows // CHUNK_ROWS)
    if wanted > parts:
        out, _ = ranged(out.drop(CHUNK), wanted, new_path(spark, "chunks"))
        discard(spark, path)
    return out


def scan(
    chunked: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    *,
    rank: str | None = None,
    sums: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    fills: dict[str, Column] | None = None,
) -> DataFrame:
    """Ordered per-key columns over the output of ``order_chunks``.

    rank: 1-based position; sums: running totals (this row included);
    lags: value of the previous row; fills: last non-null value up to this row.
    """
    sums, lags, fills = sums or {}, lags or {}, fills or {}
    order = _ascending(order)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    local = {"_n": F.row_number().over(w)}
    local |= {f"_s_{k}": F.coalesce(F.sum(v).over(upto), F.lit(0)) for k, v in sums.items()}
    local |= {f"_l_{k}": F.lag(F.struct(v.alias("v"))).over(w) for k, v in lags.items()}
    local |= {f"_f_{k}": F.last(v, ignorenulls=True).over(upto) for k, v in fills.items()}

    # one summary row per (key, chunk), built from the same staged rows
    position = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    parts = [F.count(F.lit(1)).alias("_cn")]
    parts += [F.coalesce(F.sum(v), F.lit(0)).alias(f"_cs_{k}") for k, v in sums.items()]
    parts += [F.max_by(F.struct(v.alias("v")), position).alias(f"_cl_{k}") for k, v in lags.items()]
    parts += [F.max_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), position)).alias(f"_cf_{k}")
              for k, v in fills.items()]
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum("_cn").over(before), F.lit(0)).alias("_bn")]
    carry += [F.coalesce(F.sum(f"_cs_{k}").over(before), F.lit(0)).alias(f"_bs_{k}") for k in sums]
    carry += [F.lag(f"_cl_{k}").over(chunks).alias(f"_bl_{k}") for k in lags]
    carry += [F.last(f"_cf_{k}", ignorenulls=True).over(before).alias(f"_bf_{k}") for k in fills]
    renamed = {k: f"_k{i}" for i, k in enumerate(keys)}
    summary = chunked.groupBy(*keys, CHUNK).agg(*parts).select(
        *[F.col(k).alias(a) for k, a in renamed.items()], F.col(CHUNK).alias("_kc"), *carry)

    on = F.col(CHUNK) == F.col("_kc")
    for k, a in renamed.items():
        on = on & F.col(k).eqNullSafe(F.col(a))
    joined = chunked.withColumns(local).join(summary, on, "left")

    out = {}
    if rank:
        out[rank] = (F.col("_n") + F.col("_bn")).cast("long")
    for k in sums:
        out[k] = F.col(f"_s_{k}") + F.col(f"_bs_{k}")
    for k in lags:
        out[k] = F.when(F.col("_n") == 1, F.col(f"_bl_{k}")).otherwise(F.col(f"_l_{k}"))["v"]
    for k in fills:
        out[k] = F.coalesce(F.col(f"_f_{k}"), F.col(f"_bf_{k}"))
    return joined.select(*[c for c in chunked.columns if c not in out],
                         *[v.alias(k) for k, v in out.items()])


def scan_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *, rank: str | None = None,
              sums: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, fills: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with the ordered columns of ``scan``. Of wide rows only key, order and used values are staged, and the rest is joined back.

    Ties of ``order`` are broken by the rows' content, so equal and null ids are fine.
    """
    names = [o for o in order if isinstance(o, str)]
    wide = [c for c, t in df.dtypes if c not in keys and c not in names and not t.startswith(NARROW)]
    if not wide and len(names) == len(order):
        whole = [*order, *[c for c in df.columns if c not in keys and c not in order and not dict(df.dtypes)[c].startswith("map")]]
        return scan(order_chunks(df, keys, whole), keys, whole, rank=rank, sums=sums, lags=lags, fills=fills).drop(CHUNK)
    given = {"s": sums or {}, "l": lags or {}, "f": fills or {}}
    by = [f"_o{i}" for i in range(len(order))]
    narrow = df.select(*keys, *[o.alias(n) for o, n in zip(_ascending(order), by)], *row_identity(df),
                       *[v.alias(f"_{kind}_{k}_") for kind, cols in given.items() for k, v in cols.items()])
    by += IDENTITY
    sums, lags, fills = ({k: F.col(f"_{kind}_{k}_") for k in cols} for kind, cols in given.items())
    out = scan(order_chunks(narrow, keys, by), keys, by, rank=rank, sums=sums, lags=lags, fills=fills)
    return rejoin(df, out.select(*IDENTITY, *([rank] if rank else []), *sums, *lags, *fills))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rank: str = "rank") -> DataFrame:
    """Exact 1-based position of every row within its key, without one task per key."""
    return scan_rows(df, keys, order, rank=rank)


IDENTITY = ("_h1", "_h2")


def row_identity(df: DataFrame) -> list[Column]:
    """128 bits that name the content of a row, nulls included; rows equal in all columns share them."""
    def part(c: str, kind: str) -> Column:
        nested = kind.startswith(("array", "map", "struct", "variant"))
        return F.to_json(F.struct(F.col(c).alias("c")), {"ignoreNullFields": "false"}) if nested else F.col(c)

    parts = [part(c, t) for c, t in df.dtypes] + [F.col(c).isNull().cast("int") for c in df.columns]
    return [F.xxhash64(*parts).alias(IDENTITY[0]), F.xxhash64(F.lit("2"), *parts).alias(IDENTITY[1])]


def rejoin(df: DataFrame, found: DataFrame) -> DataFrame:
    """``df`` with the columns of ``found``, computed from its rows and named by ``row_identity``.

    Equal rows are interchangeable: as many come back as ``found`` has for them, each with a result of its own.
    """
    wide = df.select("*", *row_identity(df)).dropDuplicates(list(IDENTITY))
    return wide.join(found, list(IDENTITY)).drop(*IDENTITY)


def packed_arrays(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Sequence[str], size: int = 10_000
) -> DataFrame:
    """Per key, ``values`` as parallel arrays in ``order``, cut into parts of at most ``size`` elements.

    Returns (keys, part_no, one array per value). A key with up to ``size`` rows has the single part 0.
    """
    pos = scan(order_chunks(df.select(*dict.fromkeys([*keys, *_names(order), *values])), keys, order), keys, order, rank="_pos")
    parts = pos.withColumn("part_no", F.floor((F.col("_pos") - 1) / F.lit(size)).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct("_pos", *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])))
    grouped = parts.groupBy(*keys, "part_no").agg(rows.alias("_rows"))
    return grouped.select(*keys, "part_no",
                          *[F.col("_rows").getField(f"v{i}").alias(v) for i, v in enumerate(values)])


def _names(order):
    if not all(isinstance(o, str) for o in order):
        raise TypeError("packed_arrays orders by column names")
    return list(order)


def measured_bytes(df: DataFrame) -> int:
    """Size of ``df`` as JSON text, by one aggregate job: an upper estimate for the broadcast check."""
    row = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("b")).first()
    return int(row["b"] or 0)


def attach(facts: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left",
           limit: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Join ``facts`` with a lookup table whose keys ``on`` are unique.

    The lookup is staged and measured by a job of its own, so its plan runs once. It is broadcast only when its size is
    within ``limit``. Beyond that both sides are shuffled on (key, salt), so a key with a large share of the facts is spread over
    ``salts`` tasks.
    """
    dim = stage(dim, "lookup")
    if measured_bytes(dim) <= limit:
        return facts.join(F.broadcast(dim), list(on), how)
    plain = [c for c, t in facts.dtypes if not t.startswith("map")]
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


#: a key is hot with more than one in HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys
HOT_SHARE = 1000
HOT_LEAST = 1000


def attach_counted(facts: DataFrame, dim: DataFrame, on: Sequence[str], rows: str, hot_rows: int | None = None) -> DataFrame:
    """Inner join with a staged lookup of unique keys whose column ``rows`` tells how many facts each key has.

    Hot keys are broadcast: by default those with more than a thousandth of the counted facts, at most a thousand keys
    whatever the input. All other keys are small enough for an ordinary shuffle join.
    """
    if hot_rows is None:
        total, most = dim.agg(F.sum(rows), F.max(rows)).first()
        hot_rows = max(HOT_LEAST, int(total or 0) // HOT_SHARE)
        if (most or 0) <= hot_rows:
            return facts.join(dim, list(on))
    hot = dim.where(F.col(rows) > hot_rows)
    cold = dim.where(F.col(rows) <= hot_rows)
    rest = facts.join(F.broadcast(hot.select(*on)), list(on), "left_anti").join(cold, list(on))
    return facts.join(F.broadcast(hot), list(on)).unionByName(rest)
