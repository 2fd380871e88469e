"""Near-duplicate groups: fingerprint pairs, connected components, cluster tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import hamming64, simhash64
from ..scale import attach_counted, order_chunks, packed_arrays, ranked, scan
from ..session import discard, new_path, stage
from .buckets import LIMIT, close_links

HOT_BUCKET = 20_000
HUB_SHARE = 1000
HUB_LEAST = 2000


def with_simhash(items: DataFrame, text: str = "content_text") -> DataFrame:
    """Add ``simhash64`` of the text; NULL where the text is empty."""
    return items.withColumn("simhash64", simhash64(F.col(text)))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def block_masks(blocks: int, threshold: int, bits: list[int] | None = None) -> list[int]:
    """Masks over ``bits`` such that values differing in at most ``threshold`` of them agree on one mask.

    The bits are cut into ``blocks`` runs; each mask joins ``blocks - threshold`` of them (pigeonhole).
    """
    bits = list(range(64)) if bits is None else bits
    cuts = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    runs = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(runs, blocks - threshold)]


def block_count(distinct_hashes: int, threshold: int) -> int:
    """Blocks so that a bucket of a mask holds few hashes: more hashes need wider masks."""
    blocks = threshold + 1
    while blocks < threshold + 5 and 2 ** (64 * (blocks - threshold) // blocks) < 16 * distinct_hashes:
        blocks += 1
    return blocks


def _bucketed(hashes: DataFrame, masks: list[int]) -> DataFrame:
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("h").bitwiseAND(F.lit(_signed(m))).alias("k"))
                       for i, m in enumerate(masks)])
    return hashes.select("h", F.inline(tables))


def _first_match(xor: Column, masks: list[int], table: Column) -> Column:
    """True when no earlier mask matches too: each pair comes out of exactly one table."""
    clash = F.lit(False)
    for i, m in enumerate(masks[:-1]):
        clash = clash | ((table > i) & (xor.bitwiseAND(F.lit(_signed(m))) == 0))
    return ~clash


def _pairs_in(buckets: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    a, b = buckets.alias("a"), buckets.alias("b")
    same = F.col("a.h") < F.col("b.h")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, same & (hamming64(F.col("a.h"), F.col("b.h")) <= threshold)).select(
        F.col("a.h").alias("hash_a"), F.col("b.h").alias("hash_b"), *[F.col(f"a.{k}").alias(k) for k in keys])


def near_dup_pairs(items: DataFrame, threshold: int = 3, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """All pairs of *distinct* fingerprints at Hamming distance 1..threshold.

    Copies share a fingerprint and are never paired with each other; ``copy_links`` ties them to it.
    The comparison is a banded equi-join, complete by the pigeonhole principle. The number of blocks
    follows the number of distinct fingerprints; buckets larger than ``hot_bucket`` are compared on finer
    masks that also cover the bits their own mask leaves out, so no bucket is compared all against all.
    """
    # a filter before the stage would be pushed below the fingerprints and make them a second time
    hashes = stage(items.select(F.col("simhash64").alias("h")).distinct(), "hashes").where("h is not null")
    masks = block_masks(block_count(hashes.count(), threshold), threshold)
    buckets = _bucketed(hashes, masks)
    hot = stage(buckets.groupBy("t", "k").count().where(F.col("count") > hot_bucket).select("t", "k"), "hot")
    if hot.isEmpty():
        found = _pairs_in(buckets, ["t", "k"], threshold)
    else:
        cold = _pairs_in(buckets.join(hot, ["t", "k"], "left_anti"), ["t", "k"], threshold)
        found = cold.unionByName(_hot_pairs(buckets.join(hot, ["t", "k"], "left_semi"), masks, threshold))
    xor = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    return found.where(_first_match(xor, masks, F.col("t"))).select(
        "hash_a", "hash_b", F.bit_count(xor).cast("int").alias("distance"))


def _hot_pairs(hot: DataFrame, masks: list[int], threshold: int) -> DataFrame:
    out = None
    for t, mask in enumerate(masks):
        free = [b for b in range(64) if not mask >> b & 1]
        finer = [mask | m for m in block_masks(min(threshold + 3, len(free)), threshold, free)] \
            if len(free) > threshold else [mask]
        rows = _bucketed(hot.where(F.col("t") == t).select("h"), finer).withColumnRenamed("t", "t2")
        pairs = _pairs_in(rows, ["t2", "k"], threshold)
        xor = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
        pairs = pairs.where(_first_match(xor, finer, F.col("t2"))).select(
            "hash_a", "hash_b", F.lit(t).alias("t"), "k")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _refine(distinct_hashes: int, threshold: int):
    """Masks for ``close_links``: the banded tables first, then finer ones over the bits that a mask leaves out."""
    def refine(mask: int) -> list[int]:
        if not mask:
            return block_masks(block_count(distinct_hashes, threshold), threshold)
        free = [b for b in range(64) if not mask >> b & 1]
        return [mask | m for m in block_masks(min(threshold + 3, len(free)), threshold, free)]

    return refine


def near_links(items: DataFrame, threshold: int = 3, forest: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """(a, b): enough links between *distinct* fingerprints to connect all that are within ``threshold`` bits, directly or over others.

    Unlike ``near_dup_pairs`` the output grows with the fingerprints, not with the pairs of a group. With ``forest``, an earlier result of
    ``connected_components``, only fingerprints outside of it are compared, among themselves and with all others; those of the forest must
    have been compared with each other before. Fingerprints without a link are not in a forest and count as new.
    """
    hashes = items.select(F.col("simhash64").alias("h")).distinct()
    if forest is not None:
        hashes = hashes.join(forest.select(F.col("node").alias("h"), F.lit(False).alias("fresh")), "h", "left").withColumn(
            "fresh", F.coalesce("fresh", F.lit(True)))
    hashes = stage(hashes, "hashes").where("h is not null")
    return close_links(hashes, threshold, _refine(hashes.count(), threshold), fresh=None if forest is None else "fresh", limit=limit)


def copy_links(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """(fingerprint, lowest item id) → every other item with the same fingerprint, as star edges."""
    # read three times, and filtered after the stage: the fingerprints are made once
    rows = stage(items.select("simhash64", item_id), "fingerprints").where("simhash64 is not null")
    first = stage(rows.groupBy("simhash64").agg(F.min(item_id).alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    return attach_counted(rows, first, ["simhash64"], "n").where(F.col(item_id) != F.col("first_id")).select(
        "simhash64", "first_id", F.col(item_id).alias("copy_id"))


def connected_components(edges: DataFrame, a: str, b: str, forest: DataFrame | None = None) -> DataFrame:
    """(node, component) for all nodes of an undirected edge list; component = smallest node in it.

    Alternating large-star / small-star contraction (Kiveris et al., 2014). A node's minimum is a grouped
    aggregate with map-side combine. Handing it to the neighbours is a shuffle join, except for hubs, nodes with more than
    one in ``HUB_SHARE`` of the edges: there are at most as many of them, and they are broadcast, so no task holds the edges of a hub.
    Each round is staged and the one before deleted; one aggregate tells whether only stars are left, and how large the largest hub is.

    ``forest`` is an earlier (node, component) result whose links hold on; only the new edges then need contraction.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    if forest is not None:
        e = e.unionByName(forest.select(F.col("node").alias("u"), F.col("component").alias("v")))
    path = new_path(spark, "edges")
    e = stage(e.where("u <> v").distinct(), "edges", path=path)
    n, degree, stars = _shape(e)
    while not stars:
        limit = max(HUB_LEAST, 2 * n // HUB_SHARE)
        hubs = limit if degree > limit else None
        following = new_path(spark, "edges")
        e = stage(_small_star(_large_star(e, hubs), hubs), "edges", path=following)
        discard(spark, path)
        path = following
        n, degree, stars = _shape(e)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))


def _shape(e: DataFrame) -> tuple[int, int, bool]:
    """(edges, largest degree, is every edge one of a star around a smallest node?)"""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    r = nodes.agg(F.sum("up"), F.max(F.col("up") + F.col("down")), F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return int(r[0] or 0), int(r[1] or 0), not r[2]


def _with_low(rows: DataFrame, low: DataFrame, hubs: int | None) -> DataFrame:
    """``rows`` with the minimum ``m`` of their ``u``; nodes with more than ``hubs`` rows apart."""
    if hubs is None:
        return rows.join(low.drop("n"), "u")
    hot = F.broadcast(low.where(F.col("n") > hubs).drop("n"))
    rest = rows.join(hot.select("u"), "u", "left_anti").join(low.where(F.col("n") <= hubs).drop("n"), "u")
    return rows.join(hot, "u").unionByName(rest)


def _large_star(e: DataFrame, hubs: int | None = None) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_low(both.where("v > u"), low, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, hubs: int | None = None) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_low(e, low, hubs).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def fingerprint_components(items: DataFrame, threshold: int = 3, forest: DataFrame | None = None) -> DataFrame:
    """(node, component) of all fingerprints with a near one; with ``forest`` an earlier result is completed instead of made anew."""
    return connected_components(near_links(items, threshold, forest), "a", "b", forest)


def cluster_members(items: DataFrame, threshold: int = 3, since: Column | None = None,
                    max_items: int | None = None) -> DataFrame:
    """(primary_id, item_id, published_at) for every item in a group of two or more near duplicates.

    Items need item_id, simhash64, published_at. ``since`` keeps items published from then on;
    ``max_items`` keeps the oldest ones (off by default). The primary is the earliest published member.
    """
    # filtered after the stage: the fingerprints are made once
    pool = stage(items.select("item_id", "simhash64", "published_at"), "pool").where("simhash64 is not null")
    if since is not None:
        pool = pool.where(F.col("published_at") >= since)
    if max_items is not None:
        pool = pool.orderBy(F.col("published_at").asc_nulls_last(), "item_id").limit(max_items)
        pool = stage(pool, "pool")
    near = fingerprint_components(pool, threshold)
    hashes = pool.groupBy("simhash64").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("published_at", "item_id")).alias("first"))
    # one row per fingerprint from here on: groups of copies have already collapsed
    grouped = hashes.join(near.withColumnRenamed("node", "simhash64"), "simhash64", "left").withColumn(
        "component", F.coalesce("component", "simhash64"))
    heads = grouped.groupBy("component").agg(F.sum("n").alias("size"), F.min("first").alias("head")).where("size > 1")
    lookup = stage(grouped.join(heads, "component").select(
        "simhash64", F.col("head.item_id").alias("primary_id"), "size", "n"), "lookup")
    return attach_counted(pool, lookup, ["simhash64"], "n").select("primary_id", "item_id", "published_at", "simhash64", "size")


def build_clusters(items: DataFrame, threshold: int = 3, since: Column | None = None,
                   max_items: int | None = None, part_size: int = 10_000) -> DataFrame:
    """Cluster table (primary_id, part_no, related_item_ids): related items in time order.

    A cluster with more than ``part_size`` related items continues in further parts.
    """
    related = cluster_members(items, threshold, since, max_items).where("item_id <> primary_id")
    return packed_arrays(related, ["primary_id"], ["published_at", "item_id"], ["item_id"], part_size).select(
        "primary_id", "part_no", F.col("item_id").alias("related_item_ids"))


def clusters_in_report(clusters: DataFrame, items: DataFrame, limit: int | None = None) -> DataFrame:
    """Clusters, all their parts, whose primary item is in the report, numbered from the newest; the first ``limit`` clusters if given."""
    # read twice: the titles that the report goes by are made once
    kept = stage(clusters.join(items.select(F.col("item_id").alias("primary_id")), "primary_id", "left_semi"), "kept")
    heads = kept.groupBy("primary_id").agg(F.max("created_at").alias("created_at")).withColumns(
        {"_all": F.lit(0), "_age": -F.unix_micros("created_at")})
    if limit is not None:
        heads = heads.orderBy("_age", "primary_id").limit(limit)
    numbered = ranked(heads, ["_all"], ["_age", "primary_id"], "cluster_no").select("primary_id", "cluster_no")
    return kept.join(numbered, "primary_id")


def cluster_lookup(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """One row per primary (position 0) and related item with its title, url and time.

    Positions run on over the parts of a cluster, whatever their lengths. Ids without an item keep a row; the id itself is then the title.
    """
    extra = ["cluster_no"] if "cluster_no" in clusters.columns else []
    sizes = clusters.select("primary_id", "part_no", F.size("related_item_ids").cast("long").alias("n"))
    before = scan(order_chunks(sizes, ["primary_id"], ["part_no"]), ["primary_id"], ["part_no"], sums={"upto": F.col("n")}).select(
        "primary_id", "part_no", (F.col("upto") - F.col("n")).alias("_before"))
    related = clusters.join(before, ["primary_id", "part_no"]).select(
        "primary_id", *extra, "_before", F.posexplode("related_item_ids").alias("_i", "item_id"))
    heads = clusters.where("part_no = 0").select("primary_id", *extra, F.lit(0).cast("long").alias("position"), F.col("primary_id").alias("item_id"))
    wanted = heads.unionByName(related.select("primary_id", *extra, (F.col("_before") + F.col("_i") + 1).alias("position"), "item_id"))
    found = items.select("item_id", "title", "url", "published_at", F.lit(True).alias("_known"))
    return wanted.join(found, "item_id", "left").select(
        "primary_id", *extra, "position", "item_id",
        F.when(F.col("_known"), F.coalesce("title", F.lit("Без заголовка")))
        .otherwise(F.col("item_id").cast("string")).alias("title"),
        F.coalesce("url", F.lit("")).alias("url"), "published_at")


