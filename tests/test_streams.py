"""Streams over several micro-batches agree with the batch operators."""

import datetime as dt
import random

from pyspark.sql import functions as F

from newsloom.operators import health, posts, sinks
from newsloom.session import new_path
from newsloom.streaming import jobs

RUN = "source_id int, run_at timestamp, run_id int, ok boolean, http_status int, retry_after int, error string"


def run_rows(n=240):
    rnd, t = random.Random(4), dt.datetime(2024, 1, 1)
    return [(0 if rnd.random() < 0.5 else rnd.randrange(1, 6), t + dt.timedelta(minutes=i), i, rnd.random() < 0.3, rnd.choice([None, 429]),
             rnd.choice([None, 90]), rnd.choice(["timeout", "FloodWait 33s", "Blocked by robots.txt"])) for i in range(n)]


def stream_of(spark, df, order, files):
    """``df`` as a file stream of one file per micro-batch, in order."""
    path = new_path(spark, "stream")
    rows = df.orderBy(order).collect()
    for i in range(files):
        part = rows[i * len(rows) // files:(i + 1) * len(rows) // files]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streaks_folds_and_stream_agree(spark):
    rows = run_rows()
    df = spark.createDataFrame(rows, RUN)
    streak, want = {}, {}
    for r in rows:
        streak[r[0]] = 0 if r[3] else streak.get(r[0], 0) + 1
        want[r[2]] = streak[r[0]]
    runs = health.backoff_until(df)
    assert {r.run_id: r.consecutive_failures for r in runs.collect()} == want
    last = {r.source_id: (r.consecutive_failures, r.backoff_until) for r in posts.latest_per_key(runs, ["source_id"], ["run_at", "run_id"]).collect()}
    folded = {r.source_id: r for r in health.fold_runs(df).collect()}
    assert {k: (r.consecutive_failures, r.backoff_until) for k, r in folded.items()} == last
    target = new_path(spark, "health")
    jobs.stream_health(stream_of(spark, df, "run_id", 4), target).awaitTermination()
    assert {r.source_id: r for r in jobs.read_state(spark, target).select(*health.fold_runs(df).columns).collect()} == folded


def test_dedup_survives_restarts(spark):
    rows = [(f"k{i % 40}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at timestamp, i int")
    target = new_path(spark, "dedup")
    stream = stream_of(spark, df, "i", 5)
    for _ in range(2):
        jobs.stream_dedup(stream, target, ["k"], "at").awaitTermination()
    got = spark.read.parquet(f"{target}/rows").collect()
    assert sorted(r.k for r in got) == sorted({r[0] for r in rows}) and {r.i for r in got} == set(range(40))


def test_dedup_keeps_late_new_keys(spark):
    t = dt.datetime(2024, 1, 10)
    rows = [("a", t, 0), ("b", t + dt.timedelta(hours=1), 1), ("old", dt.datetime(2024, 1, 1), 2), ("a", t, 3)]
    target = new_path(spark, "dedup")
    jobs.stream_dedup(stream_of(spark, spark.createDataFrame(rows, "k string, at timestamp, i int"), "i", 4), target, ["k"], "at").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{target}/rows").collect()) == ["a", "b", "old"]


def test_late_policy_compares_with_the_batches_before(spark):
    t = dt.datetime(2024, 1, 10)
    rows = [("a", t, 0), ("within", t - dt.timedelta(hours=47), 1), ("beyond", t - dt.timedelta(hours=49), 2), ("none", None, 3)]
    target = new_path(spark, "late")
    df = spark.createDataFrame(rows, "k string, at timestamp, i int")
    jobs.late_policy(stream_of(spark, df, "i", 4), target, "at").awaitTermination()
    assert sorted(r.k for r in jobs.appended_rows(spark, target, df.schema).collect()) == ["a", "none", "within"]


def test_cursor_over_batches(spark):
    df = spark.createDataFrame([("a", str(i), i) for i in range(8, 120)] + [("b", x, 200 + i) for i, x in enumerate(["9", "x2", "10"])], "s string, id string, o int")
    target = new_path(spark, "cursor")
    jobs.stream_cursor(stream_of(spark, df, "o", 3).drop("o"), target, "s", "id").awaitTermination()
    assert {r.s: r.cursor for r in jobs.read_state(spark, target).collect()} == {"a": "119", "b": "x2"}


def test_ingest_inserts_once(spark):
    rows = [(f"https://a/{i % 30}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i) for i in range(90)]
    df = spark.createDataFrame(rows, "url string, fetched_at timestamp, i int")
    target = new_path(spark, "ingest")
    jobs.stream_ingest(stream_of(spark, df, "i", 3), target, lambda b: b.withColumn("canonical_url", F.col("url")).withColumn("period_month", F.to_date("fetched_at"))).awaitTermination()
    assert {r.i for r in spark.read.parquet(f"{target}/items").collect()} == set(range(30))


def test_rate_stream_in_append_mode(spark):
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=20 * i), i) for i in range(120)]
    df = spark.createDataFrame(rows, "scope string, ts timestamp, i int")
    out = jobs.run_to_table(jobs.stream_rate(stream_of(spark, df, "i", 3).drop("i"), "scope"), new_path(spark, "rate"), "append")
    got = out.collect()
    assert got and all(r.requests == 3 for r in got)


def test_rate_slots_and_upsert_table(spark):
    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([(i, "s", t + dt.timedelta(seconds=i * 10)) for i in range(12)], "request_id int, scope string, ts timestamp")
    got = {x.request_id: (x.admitted, x.run_at) for x in health.rate_slots(r, "scope", 4).collect()}
    assert [i for i in got if not got[i][0]] == [4, 5, 10, 11] and got[4][1] == t + dt.timedelta(minutes=1)
    path = new_path(spark, "daily")
    rows = [("A", dt.date(2024, 1, 1), 1.0, 1, "2024-01"), ("A", dt.date(2024, 2, 1), 2.0, 1, "2024-02")]
    ddl = "series string, period_date date, value double, fetched_at int, month string"
    sinks.upsert_table(spark, path, spark.createDataFrame(rows, ddl), ["series", "period_date"], "fetched_at", "month")
    sinks.upsert_table(spark, path, spark.createDataFrame([("A", dt.date(2024, 1, 1), 9.0, 2, "2024-01")], ddl), ["series", "period_date"], "fetched_at", "month")
    assert sorted((str(x.period_date), x.value) for x in spark.read.parquet(path).collect()) == [("2024-01-01", 9.0), ("2024-02-01", 2.0)]


def test_key_table_reads_few_files_and_survives_repetition(spark):
    from newsloom.operators.keytable import KeyTable
    from newsloom.operators import keytable

    root = new_path(spark, "known")
    table = KeyTable(spark, root, ["a", "b"])
    assert table.lookup(spark.createDataFrame([("x", 1)], "a string, b int")) is None
    old, keytable.BUCKET_KEYS = keytable.BUCKET_KEYS, 500
    try:
        rows = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("a"), (F.col("id") % 7).cast("int").alias("b"))
        table.add(rows)
        files = spark.read.parquet(f"{root}/keys").inputFiles()
        assert len(files) == 400
        fresh = spark.range(100).select(F.concat(F.lit("new"), F.col("id").cast("string")).alias("a"), F.lit(1).alias("b"))
        found = table.lookup(fresh)
        assert found is None or len(found.inputFiles()) < 4  # under one in a hundred
        mixed = fresh.unionByName(rows.where("id % 50000 = 7" if "id" in rows.columns else "a in ('k7', 'k50007')"))
        assert len(table.lookup(mixed).inputFiles()) < 8
        assert table.absent(mixed).count() == 100
        # a null key is never known, equal keys with other second parts are others
        odd = spark.createDataFrame([("k7", None), ("k7", 1), ("k7", 0)], "a string, b int")
        table.add(odd)
        assert {tuple(r) for r in table.absent(odd.unionByName(spark.createDataFrame([("k7", 5)], "a string, b int"))).collect()} == {("k7", None), ("k7", 5)}
        for i in range(12):
            table.add(spark.createDataFrame([(f"s{i}", 0)], "a string, b int"), f"seg{i}")
            table.compact(without=f"seg{i}", most=4)
        assert len(table.segments()) <= 6
        assert table.absent(spark.createDataFrame([(f"s{i}", 0) for i in range(13)], "a string, b int")).collect()[0].a == "s12"
        assert table.absent(mixed).count() == 100
    finally:
        keytable.BUCKET_KEYS = old


def test_append_new_repeats_a_batch(spark):
    path = new_path(spark, "table") + "/items"
    df = lambda rows: spark.createDataFrame(rows, "k string, at int, m int")
    assert sinks.append_new(spark, path, df([("a", 0, 1), ("c", 5, 3), ("c", 4, 3), (None, 1, 1)]), ["k"], ["at"], ["m"], "s-0") == 3
    for _ in range(2):  # a repeated batch replaces its own rows
        assert sinks.append_new(spark, path, df([("d", 1, 1), ("c", 9, 9)]), ["k"], ["at"], ["m"], "s-1") == 1
    # rows were written, keys were not: a crash in between
    df([("half", 1, 1), ("e", 1, 1)]).write.partitionBy("m").parquet(f"{path}/ingest_batch=s-2")
    assert sinks.append_new(spark, path, df([("e", 1, 1)]), ["k"], ["at"], ["m"], "s-2") == 1
    assert sinks.append_new(spark, path, df([("e", 1, 1), ("a", 1, 1)]), ["k"], ["at"], ["m"], "t-0") == 0
    got = spark.read.parquet(path).collect()
    assert sorted(str(r.k) for r in got) == ["None", "a", "c", "d", "e"]
    assert {r.k: r["at"] for r in got}["c"] == 4


def test_append_new_to_a_table_of_other_origin(spark):
    path = new_path(spark, "table") + "/items"
    df = lambda rows: spark.createDataFrame(rows, "k string, at int, m int")
    df([("a", 1, 1), ("b", 2, 2)]).write.partitionBy("m").parquet(path)
    assert sinks.append_new(spark, path, df([("a", 0, 1), ("c", 5, 3)]), ["k"], ["at"], ["m"], "s-0") == 1
    assert sinks.append_new(spark, path, df([("a", 0, 1), ("c", 5, 3)]), ["k"], ["at"], ["m"], "s-0") == 0
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_run_log_of_the_ingest(spark):
    rows = [(f"u{i % 30}", i, i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "canonical_url string, i int, left_out int")
    target = new_path(spark, "runlog")
    jobs.stream_ingest(stream_of(spark, df, "i", 3), target, lambda b: b.where("i % 10 <> 0"), order=["i"], partition_by=[]).awaitTermination()
    log = sorted(map(tuple, jobs.run_log(spark, target).select("fetched", "matched", "inserted", "skipped", "truncated").collect()))
    assert log == [(30, 27, 0, 27, 18), (30, 27, 0, 27, 18), (30, 27, 27, 0, 18)]


def test_state_is_written_as_changes_and_folded(spark):
    from newsloom.session import folder_names

    target = new_path(spark, "state")
    full = {}
    for version in range(27):
        changed = [(k, version) for k in ({version % 5, 100 + version % 3} if version else set(range(200)))]
        full.update(dict(changed))
        df = spark.createDataFrame(changed, "k int, v int")
        for _ in range(2 if version in (11, 12, 22) else 1):  # repeated batches
            jobs.write_changes(df, target, version, ["k"], compact_after=5)
        if version:
            assert spark.read.parquet(f"{target}/state/delta={version}").count() == len(changed)
    assert {r.k: r.v for r in jobs.read_state(spark, target).collect()} == full
    assert len(folder_names(spark, f"{target}/state")) <= 2 + 2 * 7
    before = {r.k: r.v for r in jobs.read_state(spark, target, 26).collect()}
    assert before != full and before[26 % 5] == 21


def test_purge_switches_by_one_manifest(spark, monkeypatch):
    import pytest
    from newsloom.operators.versioned import VersionedTable, purge_table

    rows = spark.createDataFrame([(i, i % 4, f"p {i % 3}/x") for i in range(24)] + [(99, 1, None)], "id int, scope int, part string")
    summaries = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), "approved"), (2, 2, dt.datetime(2024, 1, 1), "draft")],
                                      "scope int, summary_id int, created_at timestamp, status string")
    table = VersionedTable(spark, new_path(spark, "versioned"), "part", rows.schema)
    assert table.read().count() == 0
    table.write(rows)
    before = sorted(map(str, table.read().collect()))
    assert before == sorted(map(str, rows.collect()))
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_switch", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            purge_table(table, summaries, "scope")
    assert sorted(map(str, table.read().collect())) == before
    purge_table(table, summaries, "scope")
    assert sorted(r.id for r in table.read().collect()) == [i for i in range(24) if i % 4 != 1]
    assert sorted(map(str, table.read(version=0).collect())) == before
    only = rows.where("id = 2")
    table.write(only.withColumn("scope", F.lit(7)), [v for v in table.entries() if "2" in v])
    assert {r.scope for r in table.read().where("part = 'p 2/x'").collect()} == {7}
    table.vacuum(keep=1)
    assert len(table.versions()) == 1 and table.read().where("part <> 'p 2/x'").count() == 12


def test_streams_read_tables_of_one_file_and_of_many(spark):
    from newsloom.plans.catalog import QUERIES

    pages = spark.createDataFrame([(i, f"https://a.example/{i % 7}", f"<title>t{i}</title><p>text {i}</p>") for i in range(21)], "page_id long, url string, html string")
    turns = spark.createDataFrame([(i // 3, i % 3, "user" if i % 2 else "bot", f"x{i}") for i in range(30)], "conv_id long, turn int, role string, text string")
    documents = spark.createDataFrame([(1, "some text", "en", "src1", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    found = []
    for files in (1, 3):
        root = new_path(spark, "tables")
        for name, df in (("pages", pages), ("conversations", turns), ("documents", documents)):
            folder = f"{root}/{name}.parquet"
            df.repartition(files).write.parquet(folder)
            if files == 1:  # the one part file in place of the folder
                jvm = spark.sparkContext._jvm
                path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
                fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
                part = next(s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().endswith(".parquet"))
                fs.rename(part, path(f"{root}/moved"))
                fs.delete(path(folder), True)
                fs.rename(path(f"{root}/moved"), path(folder))
        found.append([sorted(map(tuple, QUERIES[q](spark, root).collect())) for q in ("stream_cursor", "stream_dedup", "stream_ingest")])
    assert found[0] == found[1]
    cursors, urls, items = found[1]
    assert cursors == [("bot", "9001"), ("user", "9002")] and len(urls) == 7
    assert len(items) == 7


def test_backfill_pages_the_whole_history(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [("a", i, day(30 - (25 - i) // 3)) for i in range(1, 26)] + [("b", 1, day(30)), ("b", 2, None), (None, 1, day(5)), (None, 2, day(25))]
    rows += [("late", i, day(10) if i == 20 else day(28)) for i in range(1, 26)]
    kept, status = jobs.backfill(spark.createDataFrame(rows, "channel string, message_id int, published_at timestamp"), dt.date(2024, 1, 25), page_size=5)
    got = {r.channel: (r.pages, r.reached_until, r.kept, r.wanted, r.last_message_id, r.first_message_id, r.oldest_at) for r in status.collect()}
    assert got == {"a": (4, True, 18, 18, 25, 1, day(22)), "b": (1, False, 2, 2, 2, 1, day(30)), None: (1, True, 1, 1, 2, 1, day(5)),
                   "late": (2, True, 9, 24, 25, 1, day(10))}
    held = kept.groupBy("channel").agg(F.count_if("in_pages").alias("k"), F.count(F.lit(1)).alias("w")).collect()
    assert {r.channel: (r.k, r.w) for r in held} == {c: (v[2], v[3]) for c, v in got.items()}
