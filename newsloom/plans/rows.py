"""Queries over filters, orders, pages, sinks and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import filters, paging, posts, sections, sinks
from ..operators.health import fold_runs
from ..scale import keep_first
from .registry import joined, query, ts_text
from .views import (COMPETITOR_TERMS, COMPETITORS, INDICATOR_ROWS, ITEMS, MESSAGES, NORM, RUN_LOG, SOURCES, competitors,
                    indicator_rows, items, mentions_sql, messages, names_sql, run_log, sources, ts_sql)

NOW = dt.datetime(2024, 1, 31)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
GLOBAL = {"global_include_keywords": ["Und"], "global_exclude_keywords": ["cionado"], "match_whole_words": False}


def mean_price():
    """Mean price from an exact decimal sum, so that it does not depend on the order of addition."""
    return F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))


# --- keyword rules -----------------------------------------------------------------------------------

@query("keep_by_keywords", f"""
WITH {ITEMS} SELECT item_id FROM items
WHERE NOT contains(lower(content_text), 'cionado') AND (contains(lower(content_text), 'reation') OR contains(lower(content_text), 'eauon'))""")
def _(t):
    return filters.keep_by_keywords(items(t), F.col("content_text"), ["Reation", " eauon"], ["cionado"]).select("item_id")


@query("keep_by_whole_words", rf"""
WITH {ITEMS} SELECT item_id FROM items WHERE NOT regexp_matches(lower(content_text), '(^|[^\pL\pN\pM_])the([^\pL\pN\pM_]|$)')""")
def _(t):
    return filters.keep_by_keywords(items(t), F.col("content_text"), [], ["the"], whole_words=True).select("item_id")


RULES_SQL = f"""{ITEMS}, {SOURCES}, effective AS (
  SELECT source_id, list_concat(include_words, list_filter(['und'], lambda w: NOT list_contains(include_words, w))) AS inc,
         list_concat(exclude_words, list_filter(['cionado'], lambda w: NOT list_contains(exclude_words, w))) AS exc, match_whole_words AS whole FROM sources),
judged AS (
  SELECT item_id, list_filter(exc, lambda w: CASE WHEN whole THEN regexp_matches(h, '(^|[^\\pL\\pN\\pM_])' || w || '([^\\pL\\pN\\pM_]|$)') ELSE contains(h, w) END) AS bad,
         list_filter(inc, lambda w: CASE WHEN whole THEN regexp_matches(h, '(^|[^\\pL\\pN\\pM_])' || w || '([^\\pL\\pN\\pM_]|$)') ELSE contains(h, w) END) AS good, len(inc) AS n
  FROM (SELECT item_id, source_id, lower(url || ' ' || title || ' ' || snippet || ' ' || content_text) AS h FROM items) JOIN effective USING (source_id))"""


@query("explain_keywords", f"""
WITH {RULES_SQL}
SELECT item_id, CASE WHEN len(bad) > 0 THEN 'exclude' WHEN n = 0 THEN 'no_filter' WHEN len(good) > 0 THEN 'include' ELSE 'include_missing' END AS reason,
  len(bad) = 0 AND (n = 0 OR len(good) > 0) AS keep, array_to_string(CASE WHEN len(bad) > 0 THEN bad WHEN n = 0 THEN [] ELSE good END, '|') AS matched FROM judged""")
def _(t):
    j = filters.judged_items(items(t), sources(t), GLOBAL)
    return j.select("item_id", "verdict.reason", "verdict.keep", joined(F.col("verdict.matched_keywords")).alias("matched"))


@query("filter_cleanup", f"""
WITH {RULES_SQL} SELECT count_if(NOT (len(bad) = 0 AND (n = 0 OR len(good) > 0))) AS deleted, count(*) AS total_checked FROM judged""")
def _(t):
    return filters.filter_cleanup(items(t), sources(t), GLOBAL)[1]


@query("filter_cleanup_kept", f"WITH {RULES_SQL} SELECT item_id FROM judged WHERE len(bad) = 0 AND (n = 0 OR len(good) > 0)")
def _(t):
    return filters.filter_cleanup(items(t), sources(t), GLOBAL)[0].select("item_id")


@query("merge_filter_cfg", f"""
WITH {SOURCES} SELECT source_id, array_to_string(list_concat(include_words, ['und']), '|') AS include,
  array_to_string(list_concat(exclude_words, ['cionado']), '|') AS exclude, match_whole_words AS whole_words FROM sources""")
def _(t):
    m = filters.merge_filter_cfg(sources(t), GLOBAL)
    return m.select("source_id", joined(F.col("include")).alias("include"), joined(F.col("exclude")).alias("exclude"), "whole_words")


# --- item filters ------------------------------------------------------------------------------------

@query("search_news", f"""
WITH {ITEMS}, {SOURCES}, {COMPETITOR_TERMS}, {mentions_sql('found', 'competitor_terms', 'content_text')}
SELECT item_id FROM items i JOIN sources s USING (source_id)
WHERE (title ILIKE '%an_the%' OR snippet ILIKE '%an_the%' OR content_text ILIKE '%an_the%')
  AND (coalesce(s.competitor_id, 0) = 1 OR EXISTS (SELECT 1 FROM found f WHERE f.item_id = i.item_id AND f.entity_id = 1))""")
def _(t):
    from ..operators.tagging import tag_entities
    tagged = tag_entities(items(t), competitors(t), F.col("content_text"), "competitor_mentions")
    linked = sections.with_source(tagged, sources(t)).withColumn("competitor_id", F.col("source_competitor_id").cast("string"))
    return filters.search_news(linked, q="an_the", competitor_id="1").select("item_id")


@query("search_news_indexed", f"""
WITH {ITEMS} SELECT item_id FROM items WHERE title ILIKE '%an_the%eaon%' OR snippet ILIKE '%an_the%eaon%' OR content_text ILIKE '%an_the%eaon%'""")
def _(t):
    """The text search over a stored table with trigram postings: only files that hold all trigrams are read."""
    from ..operators.textindex import TextIndex
    from ..session import new_path
    path = new_path(t.spark, "items")
    items(t).repartitionByRange(16, "item_id").write.parquet(path)
    index = TextIndex(t.spark, path, new_path(t.spark, "trigrams"), ["title", "snippet", "content_text"])
    index.build()
    return index.search("%an_the%eaon%").select("item_id")


@query("in_period", f"""
WITH {ITEMS} SELECT item_id FROM items WHERE published_at >= TIMESTAMP '2024-01-05 00:00:00' AND published_at <= TIMESTAMP '2024-01-20 23:59:59.999999'""")
def _(t):
    return filters.in_period(items(t), dt.date(2024, 1, 5), dt.date(2024, 1, 20)).select("item_id")


@query("in_month", f"WITH {ITEMS} SELECT item_id FROM items WHERE period_month = DATE '2024-01-01'")
def _(t):
    return filters.in_period(items(t), dt.date(2024, 1, 1), dt.date(2024, 1, 31), month=dt.date(2024, 1, 1)).select("item_id")


@query("posts_in_period", """
SELECT event_id FROM events WHERE coalesce(CASE WHEN event_type <> 'view' THEN ts END, ts - INTERVAL 2 DAY) >= TIMESTAMP '2024-01-10 00:00:00'
  AND coalesce(CASE WHEN event_type <> 'view' THEN ts END, ts - INTERVAL 2 DAY) <= TIMESTAMP '2024-01-12 23:59:59.999999'""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    p = t.events.select("event_id", F.when(F.col("event_type") != "view", ts).alias("published_at"),
                        (ts - F.expr("interval 2 days")).alias("created_at"))
    return filters.posts_in_period(p, dt.date(2024, 1, 10), dt.date(2024, 1, 12)).select("event_id")


@query("since_cursor", f"""
WITH {ITEMS} SELECT item_id FROM items WHERE item_id % 5 = 0 OR published_at > TIMESTAMP '2024-01-18 00:00:00'""")
def _(t):
    e = items(t).select("item_id", F.when(F.col("item_id") % 5 != 0, F.col("published_at")).alias("lastmod"))
    return filters.since_cursor(e, dt.datetime(2024, 1, 20)).select("item_id")


@query("newer_than", f"""
WITH {MESSAGES}, cursors AS (SELECT role AS channel, median(conv_id * 1000)::BIGINT AS last_id FROM conversations WHERE role <> 'user' GROUP BY 1)
SELECT channel, message_id FROM messages LEFT JOIN cursors USING (channel) WHERE last_id IS NULL OR message_id > last_id""")
def _(t):
    m = messages(t)
    cursors = t.conversations.where("role <> 'user'").groupBy(F.col("role").alias("channel")).agg(
        F.round(F.median(F.col("conv_id") * 1000)).cast("long").alias("last_id"))
    return filters.newer_than(m, cursors, "channel", "message_id").select("channel", "message_id")


@query("not_before", f"""
WITH {MESSAGES} SELECT channel, count_if(published_at::DATE >= DATE '2024-01-20') AS kept, bool_or(published_at::DATE < DATE '2024-01-20') AS reached_until
FROM messages GROUP BY 1""")
def _(t):
    kept, reached = filters.not_before(messages(t), dt.date(2024, 1, 20), "channel")
    counts = kept.groupBy("channel").agg(F.count(F.lit(1)).alias("kept"))
    return reached.join(counts, "channel", "left").select("channel", F.coalesce("kept", F.lit(0)).alias("kept"), "reached_until")


HEALTH_SQL = f"""{RUN_LOG}, last_ok AS (SELECT source_id, max(run_at) AS ok_at FROM run_log WHERE ok GROUP BY 1),
folded AS (
  SELECT r.source_id, max(run_at) AS last_fetch_at, max(ok_at) AS last_success_at,
    count_if(NOT ok AND (ok_at IS NULL OR run_at > ok_at))::INT AS consecutive_failures,
    arg_max(ok, run_at) AS last_was_ok, max(run_at) AS last_at, max_by(coalesce(http_status, 0), run_at) AS status,
    max_by(coalesce(retry_after, 60), run_at) AS retry, max_by(coalesce(error, ''), run_at) AS err
  FROM run_log r LEFT JOIN last_ok USING (source_id) GROUP BY 1),
health AS (
  SELECT source_id, last_fetch_at, last_success_at, consecutive_failures,
    CASE WHEN NOT last_was_ok THEN date_trunc('second', last_at) + to_seconds(CASE WHEN err LIKE 'FloodWait%' THEN CAST(regexp_extract(err, '(\\d+)', 1) AS INT)
      WHEN status = 429 THEN retry WHEN err LIKE 'Blocked%' THEN 86400
      ELSE [60, 300, 900, 3600, 21600, 86400][greatest(1, least(consecutive_failures, 6))] END) END AS backoff_until,
    CASE WHEN NOT last_was_ok THEN err END AS last_error,
    30 + source_id % 4 * 10 AS fetch_frequency_min, source_id % 7 <> 0 AS enabled, source_id % 3 AS priority, 'User ' || source_id AS name
  FROM folded)"""


def health_sources(t):
    """Health state per user of the events, with settings derived from the user id."""
    s = F.col("source_id")
    null = F.lit(None).cast("string")
    return fold_runs(run_log(t)).withColumns({
        "fetch_frequency_min": F.lit(30) + s % 4 * 10, "enabled": s % 7 != 0, "priority": s % 3,
        "name": F.concat(F.lit("User "), s.cast("string")), "base_url": null, "feed_url": null, "tg_channel_username": null})


@query("fold_runs", f"""
WITH {HEALTH_SQL} SELECT source_id, {ts_sql('last_fetch_at')} AS last_fetch_at, {ts_sql('last_success_at')} AS last_success_at,
  consecutive_failures, {ts_sql('backoff_until')} AS backoff_until, last_error FROM health""")
def _(t):
    return fold_runs(run_log(t)).select("source_id", *[ts_text(F.col(c)).alias(c) for c in ("last_fetch_at", "last_success_at")],
                                        "consecutive_failures", ts_text(F.col("backoff_until")).alias("backoff_until"), "last_error")


@query("due_sources", f"""
WITH {HEALTH_SQL} SELECT source_id FROM health WHERE enabled AND (backoff_until IS NULL OR backoff_until <= {NOW_SQL})
  AND last_fetch_at <= {NOW_SQL} - to_minutes(fetch_frequency_min)""")
def _(t):
    return filters.due_sources(health_sources(t), NOW).select("source_id")


@query("filter_sources", f"""
WITH {SOURCES} SELECT source_id FROM sources WHERE source_type = 'SITEMAP' AND enabled""")
def _(t):
    return filters.filter_sources(sources(t), source_type="SITEMAP", enabled=True).select("source_id")


@query("failed_sources", f"WITH {HEALTH_SQL} SELECT source_id, consecutive_failures FROM health WHERE consecutive_failures > 0 OR last_error IS NOT NULL")
def _(t):
    return filters.filter_sources(health_sources(t), only_failed=True).select("source_id", "consecutive_failures")


@query("search_dim", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%' ORDER BY p_name, p_partkey LIMIT 50")
def _(t):
    d = filters.search_dim(t.part.select("p_partkey", "p_name"), "RE", "p_name")
    return paging.page(d, [F.col("p_name"), F.col("p_partkey")], 0, 50)


# --- orders and pages --------------------------------------------------------------------------------

@query("page_news", f"""
WITH {ITEMS} SELECT item_id, title FROM items ORDER BY CASE WHEN item_id % 4 <> 0 THEN published_at END DESC NULLS LAST, created_at DESC, item_id LIMIT 50 OFFSET 100""")
def _(t):
    i = items(t).withColumn("published_at", F.when(F.col("item_id") % 4 != 0, F.col("published_at")))
    return paging.page_news(i, 100, 50).select("item_id", "title")


@query("total_count", f"WITH {ITEMS} SELECT count(*) AS total FROM items WHERE title ILIKE '%the%'")
def _(t):
    return items(t).where(F.ilike("title", F.lit("%the%"))).agg(F.count(F.lit(1)).alias("total"))


@query("page_sources", f"WITH {HEALTH_SQL} SELECT source_id FROM health ORDER BY consecutive_failures DESC, priority DESC, source_id LIMIT 25 OFFSET 5")
def _(t):
    return paging.page_sources(health_sources(t), 5, 25, by_failures=True).select("source_id")


@query("top_due", f"""
WITH {HEALTH_SQL} SELECT source_id FROM health WHERE enabled AND (backoff_until IS NULL OR backoff_until <= {NOW_SQL})
  AND last_fetch_at <= {NOW_SQL} - to_minutes(fetch_frequency_min) ORDER BY priority DESC, last_fetch_at NULLS FIRST, source_id LIMIT 100""")
def _(t):
    return paging.top_due(filters.due_sources(health_sources(t), NOW)).select("source_id")


@query("page_indicators", f"""
WITH {INDICATOR_ROWS} SELECT indicator_name, period, value FROM indicator_rows ORDER BY indicator_name, month, row_id LIMIT 40 OFFSET 20""")
def _(t):
    return paging.page_indicators(indicator_rows(t), 20, 40).select("indicator_name", "period", "value")


@query("cap_newest", f"WITH {ITEMS} SELECT item_id FROM items ORDER BY published_at DESC, item_id LIMIT 150")
def _(t):
    return paging.cap_newest(items(t), 150, "published_at", "item_id").select("item_id")


@query("state_listing", f"""
WITH {HEALTH_SQL} SELECT source_id, {ts_sql('last_fetch_at')} AS last_fetch FROM health WHERE source_id % 4 = 1 ORDER BY last_fetch_at DESC NULLS LAST, source_id LIMIT 100""")
def _(t):
    kinds = F.element_at(F.lit(["rss", "tg", "max", "vk"]), (F.col("source_id") % 4 + 1).cast("int"))
    c = health_sources(t).withColumn("connector", kinds)
    return paging.state_listing(c, "tg", 0, 100).select("source_id", ts_text(F.col("last_fetch_at")).alias("last_fetch"))


@query("linked_digest", f"""
WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, item_id) AS rk, count(*) OVER (PARTITION BY source_id) AS n FROM items)
SELECT source_id, any_value(n) AS items, source_id || ': ' || any_value(n) || ' публикаций.' || chr(10) || chr(10) ||
  string_agg('- [' || title || '](' || url || ')', chr(10) ORDER BY rk) AS digest FROM r WHERE rk <= 20 GROUP BY 1""")
def _(t):
    return paging.linked_digest(items(t), "source_id")


@query("history_window", f"""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS value FROM orders WHERE o_orderdate::DATE >= DATE '2000-06-01' - 365 GROUP BY 1""")
def _(t):
    from ..operators.indicators import daily_series
    d = daily_series(t.orders, "AVG_PRICE", F.col("o_orderdate"), mean_price(), F.max("o_orderdate"))
    w = paging.history_window(d, F.lit("2000-06-01").cast("date"), 365)
    return w.select(F.col("period_date").cast("string").alias("day"), "value")


# --- sinks and sets ----------------------------------------------------------------------------------

@query("dedup_keep_first", f"""
SELECT doc_id, {NORM} AS norm FROM documents QUALIFY row_number() OVER (PARTITION BY {NORM} ORDER BY doc_id) = 1""")
def _(t):
    from ..functions.text import normalize_text
    return keep_first(t.documents.select("doc_id", normalize_text(F.col("text")).alias("norm")), ["norm"], ["doc_id"])


@query("insert_if_absent", f"""
SELECT doc_id, sha256({NORM}) AS text_hash FROM documents WHERE sha256({NORM}) NOT IN (SELECT sha256({NORM}) FROM benchmark)
QUALIFY row_number() OVER (PARTITION BY {NORM} ORDER BY doc_id) = 1""")
def _(t):
    from ..functions.text import text_sha256
    target = t.benchmark.select(text_sha256(F.col("text")).alias("text_hash"))
    batch = t.documents.select("doc_id", text_sha256(F.col("text")).alias("text_hash"))
    return sinks.insert_if_absent(target, batch, ["text_hash"], ["doc_id"])


@query("upsert", """
WITH a AS (SELECT o_orderdate AS d, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS v FROM orders GROUP BY 1), b AS (SELECT o_orderdate AS d, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(b.v, a.v) AS value FROM a LEFT JOIN b USING (d)""")
def _(t):
    from ..operators.indicators import daily_series
    day = F.col("o_orderdate")
    old = daily_series(t.orders, "AVG", day, mean_price(), F.max(F.lit(1)))
    new = daily_series(t.orders.where("o_orderstatus = 'F'"), "AVG", day, mean_price(), F.max(F.lit(2)))
    return sinks.upsert(old, new, ["series", "period_date"], "fetched_at").select(
        F.col("period_date").cast("string").alias("day"), "value")


@query("append_batch", f"WITH {INDICATOR_ROWS} SELECT indicator_name, period, value, 'lineitem' AS source_name, 'batch-1' AS import_batch_id FROM indicator_rows")
def _(t):
    return sinks.append_batch(indicator_rows(t).select("indicator_name", "period", "value"), "lineitem", "batch-1")


@query("write_report_tables", f"""
WITH {ITEMS} SELECT 'channel' AS section_kind, source_id AS section_name, count(*) AS items, 'Report' AS title FROM items GROUP BY ALL""")
def _(t):
    from ..session import new_path
    rows = items(t).select(F.lit("channel").alias("section_kind"), F.col("source_id").alias("section_name"), "item_id")
    root = new_path(t.spark, "report")
    rid = sinks.write_report_tables(rows, root, "Report", dt.date(2024, 1, 1), dt.date(2024, 1, 31), NOW)
    stored = t.spark.read.parquet(f"{root}/sections").where(F.col("report_id") == rid)
    meta = t.spark.read.parquet(f"{root}/reports").select(F.col("id").alias("report_id"), "title")
    return stored.groupBy("report_id", "section_kind", "section_name").agg(F.count(F.lit(1)).alias("items")).join(
        meta, "report_id").drop("report_id")


def summaries(t):
    """orders as summaries: the customer is the profile, a finished order an approved summary."""
    status = F.when(F.col("o_orderstatus") == "F", "approved").otherwise("ready")
    return t.orders.select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("summary_id"),
                           F.col("o_orderdate").alias("created_at"), status.alias("status"))


SUMMARIES = """summaries AS (
  SELECT o_custkey AS profile_id, o_orderkey AS summary_id, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'ready' END AS status FROM orders),
latest AS (SELECT * FROM summaries QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, summary_id DESC) = 1)"""


@query("purge_scope", f"""
WITH {SUMMARIES} SELECT event_id FROM events WHERE user_id NOT IN (SELECT profile_id FROM latest WHERE status = 'approved')""")
def _(t):
    p = t.events.select("event_id", F.col("user_id").alias("profile_id"))
    return sinks.purge_scope(p, summaries(t), "profile_id").select("event_id")


@query("purge_table", f"""
WITH {SUMMARIES} SELECT event_id, event_type FROM events WHERE user_id NOT IN (SELECT profile_id FROM latest WHERE status = 'approved')""")
def _(t):
    """The purge as a change of a stored table: touched partitions are rewritten, one manifest switches to them."""
    from ..operators.versioned import VersionedTable, purge_table
    from ..session import new_path
    p = t.events.select("event_id", F.col("user_id").alias("profile_id"), "event_type")
    table = VersionedTable(t.spark, new_path(t.spark, "events"), "event_type", p.schema)
    table.write(p)
    purge_table(table, summaries(t), "profile_id")
    table.vacuum(keep=1)
    return table.read().select("event_id", "event_type")


@query("reset_cursors", f"""
WITH {SUMMARIES} SELECT c_custkey AS profile_id, CASE WHEN status = 'approved' THEN 0 ELSE c_custkey * 10 END AS last_message_id,
  coalesce(status, '') <> 'approved' AS backfill_complete FROM customer LEFT JOIN latest ON c_custkey = profile_id""")
def _(t):
    p = t.customer.select(F.col("c_custkey").alias("profile_id"), (F.col("c_custkey") * 10).alias("last_message_id"), F.lit(True).alias("backfill_complete"))
    return sinks.reset_cursors(p, summaries(t), "profile_id")


@query("latest_per_key", f"""
WITH {SUMMARIES} SELECT profile_id, summary_id FROM summaries WHERE status <> 'approved'
QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, summary_id DESC) = 1""")
def _(t):
    s = posts.latest_per_key(summaries(t), ["profile_id"], ["created_at", "summary_id"], F.col("status") != "approved")
    return s.select("profile_id", "summary_id")


@query("backfill_period_month", """
SELECT event_id, strftime(CASE WHEN event_type = 'click' THEN DATE '2020-01-01' ELSE date_trunc('month', coalesce(CASE WHEN event_type <> 'view' THEN ts END, ts - INTERVAL 40 DAY)) END, '%Y-%m-%d') AS month FROM events""")
def _(t):
    i = t.events.select("event_id", F.when(F.col("event_type") == "click", F.lit("2020-01-01").cast("date")).alias("period_month"),
                        F.when(F.col("event_type") != "view", F.col("ts")).alias("published_at"),
                        (F.col("ts") - F.expr("interval 40 days")).alias("created_at"))
    return sinks.backfill_period_month(i).select("event_id", F.col("period_month").cast("string").alias("month"))


@query("merge_tail", f"""
WITH {MESSAGES}, tail AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY channel ORDER BY message_id DESC) <= 50)
SELECT m.message_id, CASE WHEN t.message_id IS NULL THEN m.text ELSE t.text || ' (edited)' END AS text FROM messages m LEFT JOIN tail t USING (message_id)""")
def _(t):
    from ..streaming.jobs import recheck_tail
    m = messages(t).select("channel", "message_id", "text")
    tail = recheck_tail(m, "channel", "message_id", 50).withColumn("text", F.concat("text", F.lit(" (edited)")))
    return posts.merge_tail(m, tail, ["message_id"]).select("message_id", "text")


@query("union_rows_dedup", f"""
WITH {INDICATOR_ROWS}, more AS (SELECT o_orderpriority AS indicator_name, 'x' AS period, count(*)::DOUBLE AS value FROM orders GROUP BY 1
  UNION ALL SELECT indicator_name, period, value + 1 FROM indicator_rows)
SELECT indicator_name, period, value FROM indicator_rows UNION ALL SELECT * FROM more WHERE (indicator_name, period) NOT IN (SELECT indicator_name, period FROM indicator_rows)""")
def _(t):
    a = indicator_rows(t).select("indicator_name", "period", "value")
    b = t.orders.groupBy(F.col("o_orderpriority").alias("indicator_name")).agg(F.lit("x").alias("period"), F.count(F.lit(1)).cast("double").alias("value"))
    return posts.union_rows_dedup(a, b.unionByName(a.withColumn("value", F.col("value") + 1)), ["indicator_name", "period"], ["value"])


@query("referenced_ids", f"""
WITH {ITEMS}, {SOURCES}, {COMPETITOR_TERMS}, {mentions_sql('found', 'competitor_terms', 'content_text')}
SELECT DISTINCT entity_id::INT AS entity_id FROM (SELECT entity_id FROM found UNION ALL SELECT competitor_id FROM sources WHERE source_id IN (SELECT source_id FROM items)) WHERE entity_id IS NOT NULL""")
def _(t):
    from .reports import linked_items
    j = linked_items(t)
    return sections.referenced_ids(j, sources(t).withColumn("competitor_id", F.col("competitor_id").cast("string")), "competitor").select(
        F.col("entity_id").cast("int").alias("entity_id"))


@query("keys_overlap", """
SELECT p_partkey, len(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type), ' '))) > 0 AS same FROM part""")
def _(t):
    return t.part.select("p_partkey", F.arrays_overlap(F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")).alias("same"))


@query("cursor_max", f"WITH {MESSAGES} SELECT channel, CAST(max(message_id) AS VARCHAR) AS cursor FROM messages GROUP BY 1")
def _(t):
    return posts.cursor_max(messages(t).withColumn("message_id", F.col("message_id").cast("string")), "channel", "message_id")


@query("date_span", f"WITH {MESSAGES} SELECT channel, {ts_sql('min(published_at)')} AS first_at, {ts_sql('max(published_at)')} AS last_at FROM messages GROUP BY 1")
def _(t):
    s = posts.date_span(messages(t), ["channel"])
    return s.select("channel", ts_text(F.col("first_at")).alias("first_at"), ts_text(F.col("last_at")).alias("last_at"))


@query("run_stats", """
SELECT user_id AS source_id, count(*) AS fetched, count_if(event_type <> 'error') AS matched, count_if(event_type = 'purchase') AS inserted,
  count_if(event_type = 'error') AS skipped, count_if(value > 50) AS truncated FROM events GROUP BY 1""")
def _(t):
    e = t.events.select(F.col("user_id").alias("source_id"), (F.col("event_type") != "error").alias("matched"),
                        (F.col("event_type") == "purchase").alias("inserted"), (F.col("event_type") == "error").alias("skipped"),
                        (F.col("value") > 50).alias("truncated"))
    return posts.run_stats(e, ["source_id"])


@query("retention", """
WITH r AS (SELECT o_orderkey AS report_id, o_orderdate AS created_at, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS newest_rank FROM orders)
SELECT report_id, newest_rank, created_at < TIMESTAMP '2000-06-01 00:00:00' - INTERVAL 900 DAY OR newest_rank > 500 AS removed FROM r""")
def _(t):
    r = t.orders.select(F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return posts.retention(r, filters.at(dt.datetime(2000, 6, 1)), 900, 500).select("report_id", "newest_rank", "removed")


@query("with_latest_summary", f"""
WITH {SUMMARIES}, {names_sql('competitors', COMPETITORS)}
SELECT c_custkey AS profile_id, coalesce(c.name, CAST(c_nationkey AS VARCHAR)) AS competitor_name, coalesce(n, 0) AS posts_count, l.status AS summary_status
FROM customer LEFT JOIN competitors c ON c.entity_id = c_nationkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey
LEFT JOIN latest l ON l.profile_id = c_custkey""")
def _(t):
    p = t.customer.select(F.col("c_custkey").alias("profile_id"), F.col("c_nationkey").alias("competitor_id"))
    e = t.events.select(F.col("user_id").alias("profile_id"))
    return posts.with_latest_summary(p, e, summaries(t), competitors(t)).select("profile_id", "competitor_name", "posts_count", "summary_status")


@query("active_without_profile", """
SELECT n_nationkey AS entity_id FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def _(t):
    e = t.nation.select(F.col("n_nationkey").alias("entity_id"), (F.col("n_nationkey") % 2 == 0).alias("is_active"))
    return posts.active_without_profile(e, t.supplier.select(F.col("s_nationkey").alias("competitor_id"))).select("entity_id")
