"""Skew-safe building blocks against plain computations, with one key holding most rows."""

import random

from pyspark.sql import functions as F

from newsloom import scale
from newsloom.operators import batches, clusters, payloads
from newsloom.session import shared_dir, stage


def skewed(spark, n=900, seed=3):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice("abc") if rnd.random() < 0.9 else None, rnd.randrange(50), i,
             rnd.choice([None, float(rnd.randrange(9))])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, ts int, id int, v double")


def test_scan_over_chunks(spark):
    rows, df = skewed(spark)
    order = ["ts", "id"]
    chunked = scale.order_chunks(df, ["k"], order)
    assert chunked.where("k = 'hot'").select(scale.CHUNK).distinct().count() > 1
    got = scale.scan(chunked, ["k"], order, rank="pos", sums={"total": F.coalesce("v", F.lit(0.0))},
                     lags={"prev": F.col("v")}, fills={"last_v": F.col("v")}).collect()
    assert len(got) == len(rows)
    want = {}
    for key in {r[0] for r in rows}:
        total, prev, last = 0.0, None, None
        for pos, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]), 1):
            total, last = total + (r[3] or 0.0), r[3] if r[3] is not None else last
            want[r[2]] = (pos, total, prev, last)
            prev = r[3]
    assert {r.id: (r.pos, r.total, r.prev, r.last_v) for r in got} == want


def test_scan_over_wide_rows(spark, monkeypatch):
    """One hot key, equal rows, null ids and orders, a map and a nested column; wide columns are not staged, no chunk is beyond its bound."""
    rnd = random.Random(12)
    rows = [("hot" if rnd.random() < 0.8 else rnd.choice(["a", None]), rnd.choice([None, 1, 2, 3]), rnd.choice([None, *range(40)]), float(rnd.randrange(5)),
             "long text", [1, None], {"a": 1}) for _ in range(600)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "k string, ts int, id int, v double, text string, a array<int>, m map<string,int>")
    staged = []
    plain = scale.stage

    def watched(rows, name, *args, **more):
        out = plain(rows, name, *args, **more)
        if name == "chunks":
            staged.append(out)
        return out

    monkeypatch.setattr(scale, "stage", watched)
    monkeypatch.setattr(scale, "CHUNK_ROWS", 60)
    out = scale.scan_rows(df, ["k"], ["ts", "id"], rank="pos", sums={"total": F.col("v")}, lags={"prev": F.col("v")}, fills={"seen": F.col("id")})
    assert out.columns == [*df.columns, "pos", "total", "prev", "seen"]
    got = out.collect()
    assert not {"text", "a", "m"} & set(staged[-1].columns) and len(staged) == 2
    assert max(r["count"] for r in staged[-1].groupBy(scale.CHUNK).count().collect()) <= 60
    assert sorted(str(tuple(r)[:7]) for r in got) == sorted(map(str, rows))
    for key in ("hot", "a", None):
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(1, len(mine) + 1))
        order = [((r.ts is not None, r.ts or 0), (r.id is not None, r.id or 0)) for r in mine]
        assert order == sorted(order)
        total, prev, seen = 0.0, None, None
        for r in mine:
            total, seen = total + r.v, r.id if r.id is not None else seen
            assert (r.total, r.prev, r.seen) == (total, prev, seen)
            prev = r.v


def test_keep_and_top(spark):
    rows, df = skewed(spark)
    first = {r.k: r.id for r in scale.keep_first(df, ["k"], ["ts", "id"]).collect()}
    last = {r.k: r.id for r in scale.keep_last(df, ["k"], ["ts", "id"]).collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        assert (first[key], last[key]) == (mine[0][2], mine[-1][2])
    top = scale.top_n(df, ["k"], [F.col("ts").desc(), F.col("id")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[1], r[2]))[:3]
    assert {r.id for r in top.where("k = 'hot'").collect()} == {r[2] for r in hot}
    many = scale.top_n(df, ["k"], [F.col("id")], 2000)
    assert many.count() == len(rows)


def test_packed_arrays(spark):
    rows, df = skewed(spark)
    parts = scale.packed_arrays(df, ["k"], ["ts", "id"], ["id"], size=40).collect()
    assert max(len(p.id) for p in parts) <= 40
    hot = [i for p in sorted((p for p in parts if p.k == "hot"), key=lambda p: p.part_no) for i in p.id]
    assert hot == [r[2] for r in sorted((r for r in rows if r[0] == "hot"), key=lambda r: r[1:3])]


def test_attach_both_ways(spark):
    _, df = skewed(spark)
    dim = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, label int")
    cast = scale.attach(df, dim, ["k"])
    salted = scale.attach(df, dim, ["k"], limit=0)
    assert "BroadcastHashJoin" in cast._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, cast.collect())) == sorted(map(str, salted.select(cast.columns).collect()))


def test_attach_with_known_counts(spark):
    _, df = skewed(spark)
    dim = df.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    plain = sorted(map(str, df.join(dim, "k").collect()))
    for hot in (10, 100, 10 ** 6):
        assert sorted(map(str, scale.attach_counted(df, dim, ["k"], "n", hot).select("k", "ts", "id", "v", "n", "top").collect())) == plain


def test_pairs_complete_with_refined_buckets(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(25)]
    hashes = {b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(0, 5))) for b in base for _ in range(12)}
    signed = [h - (1 << 64) if h >= 1 << 63 else h for h in hashes]
    df = spark.createDataFrame([(h,) for h in signed], "simhash64 long")
    brute = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 3}
    for hot in (20_000, 1):
        got = [(r.hash_a, r.hash_b) for r in clusters.near_dup_pairs(df, 3, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == brute
    for blocks in range(4, 9):
        masks = clusters.block_masks(blocks, 3)
        assert all(any((a ^ b) & m & (2 ** 64 - 1) == 0 for m in masks) for a, b in brute)


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000, 1001 + i) for i in range(60)] + [(i, i + 1) for i in range(2000, 2040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = clusters.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent}
    assert len(got) == len(parent)


def test_components_with_hubs_and_an_earlier_forest(spark, monkeypatch):
    rnd = random.Random(9)
    edges = [(5000 + i, 7) for i in range(900)] + [(5000 + rnd.randrange(900), 9000 + i) for i in range(50)] + [(i, i + 1) for i in range(100, 130)]
    later = [(129, 20), (20, 5100), (30000, 30001)]
    df = lambda e: spark.createDataFrame(e, "a int, b int")
    plain = {tuple(r) for r in clusters.connected_components(df(edges + later), "a", "b").collect()}
    monkeypatch.setattr(clusters, "HUB_LEAST", 3)
    monkeypatch.setattr(clusters, "HUB_SHARE", 50)
    assert {tuple(r) for r in clusters.connected_components(df(edges + later), "a", "b").collect()} == plain
    first = clusters.connected_components(df(edges), "a", "b").persist()
    assert {tuple(r) for r in clusters.connected_components(df(later), "a", "b", forest=first).collect()} == plain
    assert clusters.connected_components(df([(1, 1)]), "a", "b").collect() == []


def test_edges_of_a_hub_are_spread(spark):
    """No task of a round holds the edges of one node, though it has nearly all of them."""
    import tempfile

    edges = spark.range(200_000).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(F.lit(7)).alias("a"), (F.col("id") + 10**6).alias("b"))
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    out = clusters._large_star(e, 2 * 200_000 // 1000)
    path = tempfile.mkdtemp() + "/star"
    out.withColumn("p", F.spark_partition_id()).write.parquet(path)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("p").count().collect()]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    joins = out._jdf.queryExecution().executedPlan().toString()
    assert joins.count("BroadcastHashJoin") >= 2


def brute_components(values, bits):
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(values):
        for y in values[i + 1:]:
            if bin((x ^ y) & (2**64 - 1)).count("1") <= bits:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    found = {v: find(v) for v in values}
    linked = {c for v, c in found.items() if v != c}
    return {v: c for v, c in found.items() if c in linked}


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def dense(rnd):
    """A ball around one value, some smaller groups, and strangers."""
    base = rnd.getrandbits(64)
    ball = {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for _ in range(250)}
    groups = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))) for c in (rnd.getrandbits(64) for _ in range(15)) for _ in range(6)}
    far = {base ^ 0x7FFF << 40 ^ 1 << rnd.randrange(64) for _ in range(20)}
    return [signed(h) for h in ball | groups | far | {rnd.getrandbits(64) for _ in range(60)} | {0, 1, 2**64 - 1}]


def test_links_connect_all_near_fingerprints(spark):
    values = dense(random.Random(4))
    expected = brute_components(values, 3)
    df = spark.createDataFrame([(v,) for v in values + values[:5]] + [(None,)], "simhash64 long")
    for limit in (50_000, 40, 3):
        links = clusters.near_links(df, 3, limit=limit)
        got = clusters.connected_components(links, "a", "b").collect()
        assert {r.node: r.component for r in got} == expected
        assert limit < 50_000 or links.count() <= 32 * len(values)


def test_new_items_complete_an_earlier_result(spark):
    values = dense(random.Random(6))
    df = lambda v: spark.createDataFrame([(x,) for x in v], "simhash64 long")
    old, new = values[:-12], values[-12:]
    forest = clusters.fingerprint_components(df(old), 3).persist()
    got = clusters.fingerprint_components(df(old + new), 3, forest).collect()
    assert {r.node: r.component for r in got} == brute_components(values, 3)


def test_clusters_with_a_hot_group_of_copies(spark):
    rnd = random.Random(1)
    rows = [(i, 7 if i % 3 == 0 else rnd.getrandbits(63), i) for i in range(300)] + [(900, 7 ^ 1, 0), (901, None, 1)]
    items = spark.createDataFrame(rows, "item_id int, simhash64 long, t int").withColumn("published_at", F.timestamp_seconds("t"))
    parts = clusters.build_clusters(items, part_size=30).collect()
    assert {p.primary_id for p in parts} == {0} and max(len(p.related_item_ids) for p in parts) <= 30
    assert sorted(i for p in parts for i in p.related_item_ids) == sorted([i for i in range(300) if i % 3 == 0 and i] + [900])


def test_batches_keep_equal_rows_and_null_ids(spark):
    rows = [(1, "g", 30, 5, ["a", None]), (1, "g", 30, 5, [None, "a"]), (1, "g", 30, 5, ["a", None]), (None, "g", 30, 5, None), (None, "g", 20, 5, []),
            (None, None, 10, None, ["x"]), (2, "", 10, None, ["x"]), (2, "", 10, None, None)]
    df = spark.createDataFrame(rows, "id int, g string, n int, t int, more array<string>").withColumn("at", F.timestamp_seconds("t"))
    out = batches.char_batches(df, "g", ["at", "id"], F.col("n"), max_chars=70, reserve=0)
    assert out.columns == [*df.columns, "batch_no"]
    got = out.collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, rows))
    fill = {}
    for r in got:
        fill.setdefault((r.g or "", r.batch_no), []).append(r.n)
    assert all(sum(v) + len(v) - 1 <= 70 for v in fill.values())
    assert {k[1] for k in fill if k[0] == "g"} == {0, 1, 2} and {k[1] for k in fill if k[0] == ""} == {0}


def test_greedy_batches(spark):
    rnd = random.Random(11)
    rows = [(i, "hot" if rnd.random() < 0.7 else rnd.choice("ab"), rnd.randrange(1, 60) if rnd.random() < 0.97 else 400,
             rnd.randrange(10 ** 6) if rnd.random() < 0.9 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, g string, n int, t int").withColumn("at", F.timestamp_seconds("t"))
    for newest in (True, False):
        got = {r.id: r.batch_no for r in batches.char_batches(df, "g", ["at", "id"], F.col("n"), 300, 50, newest).collect()}
        for g in ("hot", "a", "b"):
            mine = sorted((r for r in rows if r[1] == g), key=lambda r: ((-r[3] if newest else r[3]) if r[3] is not None else (10 ** 9 if newest else -1), r[0]))
            batch, text = 0, -1
            for i, _, n, _ in mine:
                if text >= 0 and text + 1 + n + 50 > 300:
                    batch, text = batch + 1, -1
                text = text + 1 + n if text >= 0 else n
                assert got[i] == batch


def test_missing_facts_follow_the_sequential_rule(spark):
    rnd = random.Random(2)
    facts = [("r%d" % (i % 2), i, rnd.choice(["", f"text {rnd.randrange(25)}"]), [("l", f"u{rnd.randrange(30)}")] if rnd.random() < 0.6 else []) for i in range(120)]
    told = [("r0", "TEXT 3", [("l", " u5 ")]), ("r1", "other", [])]
    ddl = f"report_id string, fact_no int, text string, citations array<{payloads.CITATION}>"
    drafts = spark.createDataFrame(facts, ddl)
    summary = spark.createDataFrame(told, ddl.replace("fact_no int, ", ""))

    def keys(text, cites):
        return ({"t:" + text.lower()[:160]} if text else set()) | {"u:" + u.strip() for _, u in cites if u.strip()}

    want = set()
    for rep in ("r0", "r1"):
        seen = [keys(t, c) for r, t, c in told if r == rep]
        for r, no, t, c in facts:
            if r == rep and not any(keys(t, c) & s for s in seen):
                want.add((rep, no))
                seen.append(keys(t, c))
    for group_rows in (200_000, 20, 3):  # whole reports, groups in a task each, groups swept in chunks
        assert {(r.report_id, r.fact_no) for r in payloads.missing_facts(drafts, summary, group_rows=group_rows).collect()} == want


def test_a_long_chain_of_facts_takes_as_many_steps_as_chunks(spark):
    """Each fact shares a key with the next one: every second is taken."""
    n = 20_000
    cite = lambda c: F.struct(F.lit("l").alias("label"), c.cast("string").alias("url"))
    drafts = spark.range(n).select(F.lit("r").alias("report_id"), F.col("id").alias("fact_no"), F.lit("").alias("text"),
                                   F.array(cite(F.col("id")), cite(F.col("id") + 1)).alias("citations"))
    none = spark.createDataFrame([], f"report_id string, text string, citations array<{payloads.CITATION}>")
    got = payloads.missing_facts(drafts, none, group_rows=10_000)
    assert got.count() == n // 2 and got.where("fact_no % 2 = 1").isEmpty()


def test_shared_dir_is_the_session_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark) == (named or shared_dir(spark)).rstrip("/")


def counted(spark, df, name, value):
    """``df`` with a column made by Python, and the accumulator that counts how often it is made."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def make(x):
        calls.add(1)
        return value(x)

    return df.withColumn(name, make("item_id")), calls


def test_fingerprints_are_made_once(spark):
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("item_id"), F.timestamp_seconds("id").alias("published_at")).localCheckpoint()
    with_text, calls = counted(spark, rows, "text", lambda i: str(i % 500 if i % 500 else 0))
    items = with_text.withColumn("simhash64", F.xxhash64("text"))
    assert clusters.copy_links(items).count() == n - 500 and calls.value == n
    for job in (lambda x: clusters.near_dup_pairs(x), lambda x: clusters.cluster_members(x)):
        before = calls.value
        job(items).count()
        assert calls.value - before == n


def test_reports_make_their_columns_once(spark):
    from newsloom.operators import sections

    n = 400
    rows = spark.range(n).select(F.col("id").alias("item_id"), F.timestamp_seconds("id").alias("published_at"), F.lit("c").alias("source_label"),
                                 *[F.lit(None).cast("string").alias(f"primary_{k}_id") for k in ("competitor", "developer")],
                                 *[F.expr("cast(array() as array<string>)").alias(c) for c in ("competitor_mentions", "developer_mentions", "region_ids")]).localCheckpoint()
    joined, calls = counted(spark, rows, "theme", lambda i: f"t{i % 3}")
    names = spark.createDataFrame([], "entity_id string, name string")
    regions = spark.createDataFrame([], "region_id string, name string, is_active boolean")
    found = sections.report_rows(joined, names, names, regions)
    assert found.count() == 4 * n and calls.value == n
    table = spark.createDataFrame([(i, 0, [i + 1000]) for i in range(n)], "primary_id long, part_no int, related_item_ids array<long>").withColumn("created_at", F.timestamp_seconds("primary_id"))
    titled, calls = counted(spark, rows, "title", lambda i: f"t{i % 2}")
    kept = clusters.clusters_in_report(table, titled.where("title = 't1'"), limit=20)
    before = calls.value  # the result is read without making the titles again
    assert {r.primary_id: r.cluster_no for r in kept.collect()} == {n - 1 - 2 * i: i + 1 for i in range(20)} and calls.value == before > 0


def test_fingerprints_hold_a_slice_of_a_batch(monkeypatch):
    import pyarrow as pa
    from newsloom.functions import fingerprint

    rnd = random.Random(8)
    texts = [None, " ", "ab", "Ёж ёЖ Привет-мир naïve Ünï «abc»"] + [" ".join(f"w{rnd.randrange(5000)}" for _ in range(200)) for _ in range(300)]
    whole = next(fingerprint.simhash64.func(iter([pa.array(texts)]))).to_pylist()
    seen = []
    of = fingerprint.TokenDigests.of
    monkeypatch.setattr(fingerprint.TokenDigests, "of", lambda self, runs: (seen.append((len(runs), len(self))), of(self, runs))[1])
    for name, value in (("SLICE_BYTES", 10_000), ("TOKENS_KEPT", 500), ("PIECE", 7)):
        monkeypatch.setattr(fingerprint, name, value)
    assert next(fingerprint.simhash64.func(iter([pa.array(texts)]))).to_pylist() == whole
    assert len(seen) > 20 and max(n for n, _ in seen) < 3000 and max(kept for _, kept in seen) < 5000
    assert whole[:3] == [None, None, 0] and whole[3] not in (None, 0)


def test_facts_are_compared_by_short_keys(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(payloads, "stage", lambda df, name, *a, **k: (staged.append((name, dict(df.dtypes))), stage(df, name, *a, **k))[1])
    ddl = f"report_id string, fact_no int, text string, citations array<{payloads.CITATION}>"
    drafts = spark.createDataFrame([("r", 1, "x" * 400, []), ("r", 2, "X" * 400, []), ("r", 3, "told", [])], ddl)
    told = spark.createDataFrame([("r", 0, "TOLD", [])], ddl).drop("fact_no")
    assert sorted(r.fact_no for r in payloads.missing_facts(drafts, told).collect()) == [1]
    assert dict(staged)["facts"]["key"] == "binary"
