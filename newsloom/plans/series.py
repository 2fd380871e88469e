"""Queries over indicator series, source health, posts and nested payloads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators import batches, health, indicators, payloads, posts
from ..scale import keep_first
from ..session import stage
from ..sources import tables
from .registry import joined, query, ts_text
from .rows import HEALTH_SQL, NOW, NOW_SQL, health_sources
from .views import (INDICATOR_ROWS, ITEMS, MESSAGES, MONTHS_SQL, NORM, RUN_LOG, WS, indicator_rows, items, label_sql, messages,
                    run_log, ts_sql)

# --- indicators --------------------------------------------------------------------------------------


@query("change_pct", f"""
WITH {INDICATOR_ROWS}, l AS (SELECT *, lag(value) OVER (PARTITION BY indicator_name ORDER BY month, row_id) AS prev FROM indicator_rows)
SELECT indicator_name, period, value, CASE WHEN prev IS NOT NULL AND prev <> 0 THEN floor((value - prev) / abs(prev) * 100 * 100 + 0.5) / 100 END AS change_pct FROM l""")
def _(t):
    return indicators.change_pct(indicator_rows(t)).select("indicator_name", "period", "value", "change_pct")


@query("last_n", f"""
WITH {INDICATOR_ROWS} SELECT indicator_name, period, value FROM indicator_rows QUALIFY row_number() OVER (PARTITION BY indicator_name ORDER BY month DESC, row_id DESC) <= 24""")
def _(t):
    return indicators.last_n(indicator_rows(t), 24).select("indicator_name", "period", "value")


@query("distinct_names", "SELECT DISTINCT l_returnflag AS indicator_name FROM lineitem")
def _(t):
    return indicators.distinct_names(indicator_rows(t))


@query("series_arrays", f"""
WITH {INDICATOR_ROWS}, p AS (SELECT *, (row_number() OVER (PARTITION BY indicator_name ORDER BY month, row_id) - 1) // 50 AS part_no FROM indicator_rows)
SELECT indicator_name, part_no, string_agg(period, '|' ORDER BY month) AS x, string_agg(CAST(value::BIGINT AS VARCHAR), '|' ORDER BY month) AS y FROM p GROUP BY 1, 2""")
def _(t):
    s = indicators.series_arrays(indicator_rows(t), part_size=50)
    return s.select("indicator_name", "part_no", joined(F.col("x")).alias("x"), F.array_join(F.transform("y", lambda v: v.cast("long").cast("string")), "|").alias("y"))


@query("downsample", f"""
WITH {INDICATOR_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY indicator_name ORDER BY month, row_id) - 1 AS i, count(*) OVER (PARTITION BY indicator_name) AS n FROM indicator_rows),
s AS (SELECT *, greatest(1, n // 12) AS step FROM r), k AS (SELECT *, least((n - 1) // step + 1, 12) AS kept FROM s)
SELECT indicator_name, period, CASE WHEN n <= 12 THEN i WHEN i = n - 1 THEN kept - 1 ELSE i // step END AS point_no FROM k
WHERE n <= 12 OR i = n - 1 OR (i % step = 0 AND i // step < kept - 1)""")
def _(t):
    keyed = indicator_rows(t)
    return indicators.downsample(keyed, "indicator_name", ["month", "row_id"]).select("indicator_name", "period", "point_no")


@query("latest_with_change", f"""
WITH {INDICATOR_ROWS}, l AS (SELECT *, lag(value) OVER w AS prev, row_number() OVER (PARTITION BY indicator_name ORDER BY month DESC, row_id DESC) AS age FROM indicator_rows WINDOW w AS (PARTITION BY indicator_name ORDER BY month, row_id))
SELECT indicator_name, period, value, value - prev AS change FROM l WHERE age = 1""")
def _(t):
    return indicators.latest_with_change(indicator_rows(t))


@query("indicator_lines", f"""
WITH {INDICATOR_ROWS}
SELECT 'daily' AS block, '  ' || strftime(o_orderdate, '%Y-%m-%d') || ',' || count(*) || '.0' AS line FROM orders GROUP BY o_orderdate
UNION ALL SELECT 'parsed', '  ' || indicator_name || ',' || period || ',' || value::BIGINT || '.0шт' FROM indicator_rows""")
def _(t):
    daily = indicators.daily_series(t.orders, "ORDERS", F.col("o_orderdate"), F.count(F.lit(1)).cast("double"), F.max("o_orderdate"))
    return batches.indicator_lines(daily, indicator_rows(t)).select("block", "line")


# --- tables in text and cells ------------------------------------------------------------------------

def rate_lines(t):
    """orders as text lines: a period label, a separator and a rate."""
    from ..functions.dates import period_label
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    period = F.when(k % 3 == 0, F.concat(period_label(day), F.lit(" - "), period_label(F.date_add(day, 30)))).otherwise(period_label(day))
    sep = F.when(k % 2 == 0, F.lit(" | ")).otherwise(F.lit("\t"))
    rate = F.when(k % 5 == 0, F.lit("нет")).otherwise(F.concat((k % 30).cast("string"), F.when(k % 4 == 0, ".").otherwise(","), F.lit("50")))
    return t.orders.select(F.col("o_custkey").alias("doc_id"), k.alias("line_no"), F.concat(F.lit("  "), period, sep, rate, F.lit(" ")).alias("line"))


RATE_LINES = f"""rate_lines AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no,
  CASE WHEN o_orderkey % 3 = 0 THEN {label_sql('o_orderdate')} || ' - ' || {label_sql('(o_orderdate + INTERVAL 30 DAY)')} ELSE {label_sql('o_orderdate')} END AS period,
  CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 30) + 0.5 END::DOUBLE AS value FROM orders)"""


@query("date_value_rows", f"WITH {RATE_LINES} SELECT doc_id, line_no, 'Ключевая ставка' AS indicator_name, period, value, '%' AS unit FROM rate_lines WHERE value IS NOT NULL")
def _(t):
    return tables.date_value_rows(rate_lines(t)).select("doc_id", "line_no", "indicator_name", "period", "value", "unit")


def rate_texts(t):
    """One text per order: two dates and two rates in one line."""
    from ..functions.dates import period_label
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return t.orders.select(k.alias("doc_id"), F.concat(
        F.lit("Ставка с "), period_label(day), F.lit(" "), (k % 20).cast("string"), F.lit(",25 \n"), period_label(F.date_add(day, 1)),
        F.lit(" - "), period_label(F.date_add(day, 9)), F.lit("  "), (k % 7).cast("string")).alias("text"))


@query("date_value_pairs", f"""
SELECT o_orderkey AS doc_id, {label_sql('o_orderdate')} AS period, o_orderkey % 20 + 0.25::DOUBLE AS value FROM orders
UNION ALL SELECT o_orderkey, {label_sql('(o_orderdate + INTERVAL 1 DAY)')} || ' - ' || {label_sql('(o_orderdate + INTERVAL 9 DAY)')}, (o_orderkey % 7)::DOUBLE FROM orders""")
def _(t):
    return tables.date_value_pairs(rate_texts(t)).select("doc_id", "period", "value")


@query("date_value_table", f"""
SELECT o_orderkey AS doc_id, {label_sql('o_orderdate')} AS period, o_orderkey % 20 + 0.25::DOUBLE AS value FROM orders
UNION ALL SELECT o_orderkey, {label_sql('(o_orderdate + INTERVAL 1 DAY)')} || ' - ' || {label_sql('(o_orderdate + INTERVAL 9 DAY)')}, (o_orderkey % 7)::DOUBLE FROM orders""")
def _(t):
    return tables.date_value_table(rate_texts(t)).select("doc_id", "period", "value")


def cells(t):
    """lineitem as indicator × period tables: one table per return flag, one row per line number, years as columns."""
    year = F.year("l_shipdate")
    body = t.lineitem.groupBy(F.col("l_returnflag").alias("table_id"), F.col("l_linenumber").alias("row"), year.alias("y")).agg(
        F.sum("l_quantity").cast("long").alias("q"))
    name = F.when(F.col("row") % 3 == 1, F.concat(F.lit("Line "), F.col("row").cast("string"))).otherwise(F.concat(F.lit("— part "), F.col("row").cast("string")))
    values = body.select("table_id", "row", (F.col("y") - 1990).alias("col"), F.concat(
        (F.col("q") % 1000).cast("string"), F.lit(",5 (+"), (F.col("q") % 90).cast("string"), F.lit(",1%)")).alias("text"))
    rows = body.select("table_id", "row").distinct()
    numbers = rows.select("table_id", "row", F.lit(0).alias("col"), F.col("row").cast("string").alias("text"))
    names = rows.select("table_id", "row", F.lit(1).alias("col"), name.alias("text"))
    years = body.select("table_id", "y").distinct().select("table_id", F.lit(0).alias("row"), (F.col("y") - 1990).alias("col"), F.col("y").cast("string").alias("text"))
    ids = body.select("table_id").distinct()
    heads = ids.select("table_id", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("№").alias("text")).unionByName(
        ids.select("table_id", F.lit(0).alias("row"), F.lit(1).alias("col"), F.lit("Наименование показателя").alias("text")))
    return values.unionByName(numbers).unionByName(names).unionByName(years).unionByName(heads)


MATRIX = """body AS (SELECT l_returnflag AS table_id, l_linenumber AS row, year(l_shipdate) AS y, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL),
slots AS (SELECT table_id, y, row_number() OVER (PARTITION BY table_id ORDER BY y) + 1991 AS slot_y FROM (SELECT DISTINCT table_id, y FROM body)),
matrix AS (SELECT b.table_id, b.row, CAST(s.y AS VARCHAR) AS period, b.q % 1000 + 0.5::DOUBLE AS value, b.q % 90 + 0.1::DOUBLE AS change_pct
  FROM body b JOIN slots s ON s.table_id = b.table_id AND s.slot_y = b.y),
parents AS (SELECT table_id, row, CASE WHEN row % 3 = 1 THEN 'Line ' || row END AS own, 'part ' || row AS child FROM (SELECT DISTINCT table_id, row FROM matrix)),
named AS (SELECT table_id, row, CASE WHEN own IS NOT NULL THEN own ELSE coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row ROWS UNBOUNDED PRECEDING) || ' — ', '') || child END AS indicator_name FROM parents)"""


@query("unpivot_matrix", f"WITH {MATRIX} SELECT table_id, indicator_name, period, value, change_pct FROM matrix JOIN named USING (table_id, row)")
def _(t):
    return tables.unpivot_matrix(cells(t)).select("table_id", "indicator_name", "period", "value", "change_pct")


@query("classify_table", f"""
WITH {MATRIX} SELECT table_id, 'matrix' AS kind, count(*) AS n FROM matrix GROUP BY 1
UNION ALL SELECT 'rates' || (o_custkey % 5), 'date_value', count(*) FROM orders GROUP BY 1""")
def _(t):
    from ..functions.dates import period_label
    k = F.col("o_orderkey")
    tid = F.concat(F.lit("rates"), (F.col("o_custkey") % 5).cast("string"))
    base = t.orders.select(tid.alias("table_id"), (k + 1).cast("int").alias("row"), period_label(F.to_date("o_orderdate")).alias("p"), (k % 20).cast("string").alias("v"))
    rates = base.select("table_id", "row", F.lit(0).alias("col"), F.col("p").alias("text")).unionByName(
        base.select("table_id", "row", F.lit(1).alias("col"), F.concat("v", F.lit(",00")).alias("text")))
    both = cells(t).unionByName(rates).withColumn("doc_id", F.col("table_id"))
    return tables.classify_table(both).groupBy("table_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("forward_fill_parent", """
SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN event_type || '-' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS parent_name FROM events""")
def _(t):
    name = F.when(F.col("event_type") == "error", F.lit("— child")).otherwise(F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")))
    return tables.forward_fill_parent(t.events.select("event_id", "user_id", name.alias("name")), "user_id", ["event_id"]).select("event_id", "parent_name")


@query("wide_rows_from_text", """
SELECT c_custkey AS doc_id, c_name AS indicator_name, '2021' AS period, (c_custkey % 900)::DOUBLE AS value, CAST(NULL AS DOUBLE) AS change_pct FROM customer
UNION ALL SELECT c_custkey, c_name, '2022', c_custkey % 90 + 0.5, 1.25 FROM customer UNION ALL SELECT c_custkey, c_name, '2', 7, NULL FROM customer""")
def _(t):
    k = F.col("c_custkey")
    lines = t.customer.select(k.alias("doc_id"), F.posexplode(F.array(
        F.lit("Наименование   2021  2022"), F.concat(F.lit("12"), F.lit("  3")),
        F.concat("c_name", F.lit("\t"), (k % 900).cast("string"), F.lit("   "), (k % 90).cast("string"), F.lit(",5 (+1,25%)\t7")))).alias("line_no", "line"))
    return tables.wide_rows_from_text(lines).select("doc_id", "indicator_name", "period", "value", "change_pct")


# --- health ------------------------------------------------------------------------------------------

STREAKS = f"""{RUN_LOG}, islands AS (SELECT *, sum(ok::INT) OVER (PARTITION BY source_id ORDER BY run_at, run_id) AS island FROM run_log),
streaks AS (SELECT *, count_if(NOT ok) OVER (PARTITION BY source_id, island ORDER BY run_at, run_id)::INT AS consecutive_failures FROM islands)"""


@query("failure_streak", f"WITH {STREAKS} SELECT run_id, source_id, consecutive_failures FROM streaks")
def _(t):
    return health.failure_streak(run_log(t)).select("run_id", "source_id", "consecutive_failures")


@query("backoff_until", f"""
WITH {STREAKS} SELECT run_id, {ts_sql('''CASE WHEN NOT ok THEN date_trunc('second', run_at) + to_seconds(CASE WHEN error LIKE 'FloodWait%' THEN CAST(regexp_extract(error, '(\\d+)', 1) AS INT)
  WHEN http_status = 429 THEN coalesce(retry_after, 60) WHEN error LIKE 'Blocked%' THEN 86400 ELSE [60, 300, 900, 3600, 21600, 86400][least(consecutive_failures, 6)] END) END''')} AS backoff_until FROM streaks""")
def _(t):
    return health.backoff_until(run_log(t)).select("run_id", ts_text(F.col("backoff_until")).alias("backoff_until"))


@query("rate_slots", f"""
SELECT event_id AS request_id, n AS slot_no, n <= 2 AS admitted, {ts_sql("CASE WHEN n <= 2 THEN date_trunc('second', ts) ELSE hour + INTERVAL 1 MINUTE END")} AS run_at FROM (
  SELECT event_id, ts, date_trunc('minute', ts) AS hour, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS n FROM (SELECT * REPLACE (TIMESTAMP '2024-01-01' + to_microseconds(epoch_us(ts) // 50 % 86400000000) AS ts) FROM events))""")
def _(t):
    # thirty days of requests squeezed into one, so that minutes do fill up
    us = F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 50), F.lit(86_400_000_000))
    r = t.events.select(F.col("event_id").alias("request_id"), "event_type", F.timestamp_micros(F.lit(1_704_067_200_000_000) + us).alias("ts"))
    return health.rate_slots(r, "event_type", 2).select("request_id", "slot_no", "admitted", ts_text(F.col("run_at")).alias("run_at"))


ALERTS_SQL = f"""{HEALTH_SQL}, base AS (SELECT *, greatest(180, fetch_frequency_min * 2) AS stale,
    floor(epoch_us(backoff_until - {NOW_SQL}::TIMESTAMP) / 60000000) AS left_min, floor(epoch_us({NOW_SQL}::TIMESTAMP - last_success_at) / 60000000) AS since_ok FROM health WHERE enabled),
alerts AS (
  SELECT 'fail-critical:' || source_id AS id, 'critical' AS severity, 'SOURCE_CONSECUTIVE_FAILURES_HIGH' AS code, source_id, name FROM base WHERE consecutive_failures >= 3
  UNION ALL SELECT 'fail-warning:' || source_id, 'warning', 'SOURCE_CONSECUTIVE_FAILURES', source_id, name FROM base WHERE consecutive_failures IN (1, 2)
  UNION ALL SELECT 'backoff:' || source_id, CASE WHEN left_min >= 360 THEN 'critical' ELSE 'warning' END, 'SOURCE_BACKOFF_ACTIVE', source_id, name FROM base WHERE backoff_until > {NOW_SQL}
  UNION ALL SELECT 'stale:' || source_id, CASE WHEN since_ok >= stale * 2 THEN 'critical' ELSE 'warning' END, 'SOURCE_STALE_SUCCESS', source_id, name FROM base WHERE since_ok >= stale
  UNION ALL SELECT 'never-success:' || source_id, 'critical', 'SOURCE_NEVER_SUCCEEDED', source_id, name FROM base
    WHERE last_success_at IS NULL AND floor(epoch_us({NOW_SQL}::TIMESTAMP - last_fetch_at) / 60000000) >= stale)"""


@query("source_alerts", f"WITH {ALERTS_SQL} SELECT id, severity, code, source_id, name AS source_label FROM alerts")
def _(t):
    return health.source_alerts(health_sources(t), NOW).select("id", "severity", "code", "source_id", "source_label")


@query("sort_alerts", f"WITH {ALERTS_SQL} SELECT id, severity FROM alerts ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, code, id LIMIT 200")
def _(t):
    return health.source_alerts(health_sources(t), NOW, limit=200).select("id", "severity")


@query("severity_counts", f"""
WITH {ALERTS_SQL}, top AS (SELECT * FROM alerts ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, code, id LIMIT 200)
SELECT count_if(severity = 'critical') AS critical_count, count_if(severity = 'warning') AS warning_count, count_if(severity = 'info') AS info_count FROM top""")
def _(t):
    return health.severity_counts(health.source_alerts(health_sources(t), NOW, limit=200))


SCHEDULE_SQL = f"""{HEALTH_SQL}, sched AS (SELECT *, last_fetch_at + to_minutes(fetch_frequency_min) AS nxt, coalesce(backoff_until > {NOW_SQL}, false) AS blocked FROM health),
due AS (SELECT *, enabled AND nxt <= {NOW_SQL} AND NOT blocked AS is_due FROM sched)"""


@query("crawl_schedule", f"""
WITH {SCHEDULE_SQL} SELECT source_id, is_due, {ts_sql(f"CASE WHEN NOT enabled THEN NULL WHEN is_due THEN {NOW_SQL} WHEN blocked THEN greatest(backoff_until, nxt) ELSE nxt END")} AS next_expected_at FROM due""")
def _(t):
    s = health.crawl_schedule(health_sources(t), NOW, include_disabled=True)
    return s.select("source_id", "is_due", ts_text(F.col("next_expected_at")).alias("next_expected_at"))


@query("health_overview", f"""
WITH {ALERTS_SQL}, sched AS (SELECT enabled AND last_fetch_at + to_minutes(fetch_frequency_min) <= {NOW_SQL} AND NOT coalesce(backoff_until > {NOW_SQL}, false) AS is_due FROM health)
SELECT (SELECT count_if(severity = 'critical') FROM alerts) AS critical_count, (SELECT count_if(severity = 'warning') FROM alerts) AS warning_count, (SELECT count_if(is_due) FROM sched) AS due_count""")
def _(t):
    return health.health_overview(health_sources(t), NOW)


# --- posts -------------------------------------------------------------------------------------------

@query("merge_albums", f"""
WITH {MESSAGES}, u AS (SELECT *, CASE WHEN grouped_id <> 0 THEN 'g' || grouped_id ELSE 'm' || message_id END AS unit, regexp_replace(text, '^{WS}|{WS}$', '', 'g') AS body FROM messages)
SELECT channel, min(message_id) AS message_id, count(*) AS messages, coalesce(arg_max(body, message_id) FILTER (WHERE body <> ''), '') AS raw_text,
  {ts_sql('arg_min(published_at, message_id)')} AS published_at, count(image_path) AS images FROM u GROUP BY channel, unit""")
def _(t):
    a = posts.merge_albums(messages(t))
    return a.select("channel", "message_id", "messages", "raw_text", ts_text(F.col("published_at")).alias("published_at"), "images")


@query("album_images", f"""
WITH {MESSAGES}, u AS (SELECT *, CASE WHEN grouped_id <> 0 THEN 'g' || grouped_id ELSE 'm' || message_id END AS unit FROM messages),
p AS (SELECT *, min(message_id) OVER (PARTITION BY channel, unit) AS first_id FROM u)
SELECT channel, first_id AS message_id, row_number() OVER (PARTITION BY channel, unit ORDER BY message_id) AS image_no, image_path FROM p WHERE image_path IS NOT NULL""")
def _(t):
    return posts.album_images(messages(t))


GROUPS = [("Жильё", ["reation", "the and"]), ("Другое", ["eauon"]), ("Ввод МКД", ["ention"])]


def _stem_sql(token: str) -> str:
    root = token[:max(5, len(token) - 3)]
    return f"contains(h, '{root}')" if len(token) > 4 else f"contains(h, '{token}')"


@query("assign_post_group", f"""
WITH {MESSAGES}, l AS (SELECT message_id, lower(text) AS h FROM messages)
SELECT * FROM (SELECT message_id, CASE WHEN {_stem_sql('reation')} OR ({_stem_sql('the')} AND {_stem_sql('and')}) THEN 'Жильё' WHEN {_stem_sql('eauon')} THEN 'Другое'
  WHEN {_stem_sql('ention')} THEN 'Ввод МКД' END AS group_title FROM l) WHERE group_title IS NOT NULL""")
def _(t):
    m = messages(t).withColumn("matched_keywords", F.expr("cast(array() as array<string>)"))
    return posts.assign_post_group(m, GROUPS).select("message_id", "group_title")


@query("post_lines", f"""
WITH {MESSAGES}, r AS (SELECT message_id, published_at, 'https://t.me/' || channel || '/' || message_id AS url, regexp_replace(text, '^{WS}|{WS}$', '', 'g') AS raw FROM messages)
SELECT message_id, '- ' || strftime(published_at, '%Y-%m-%d') || ' | [' || regexp_replace(replace(substr(raw, 1, 200), chr(10), ' '), '^{WS}|{WS}$', '', 'g') || CASE WHEN length(raw) > 200 THEN '…' ELSE '' END
  || '](' || url || ')' || CASE WHEN length(raw) > 200 THEN chr(10) || '  ' || replace(substr(raw, 1, 900), chr(10), ' ') || CASE WHEN length(raw) > 900 THEN '…' ELSE '' END ELSE '' END AS line,
  length(raw) > 900 AS truncated FROM (SELECT * REPLACE (CASE WHEN raw = '' THEN 'Пост' ELSE raw END AS raw) FROM r)""")
def _(t):
    m = messages(t).withColumn("post_url", F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), F.col("message_id").cast("string")))
    return posts.post_lines(m).select("message_id", "line", "truncated")


@query("group_post_text", rf"""
WITH {MESSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY published_at, message_id) AS no FROM messages)
SELECT channel AS group_title, no AS post_no, '--- Пост ' || no || ' ---' || chr(10) || 'Дата: ' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10) || 'Ссылка: u' || message_id
  || coalesce(chr(10) || nullif(array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(text, '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{FE00}}-\x{{FEFF}}]+', '', 'g'), '\r\n|[\n\x0b\f\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
    lambda l: regexp_replace(l, '^{WS}|{WS}$', '', 'g')), lambda l: l <> ''), chr(10) || chr(10)), ''), '') AS block FROM n""")
def _(t):
    m = messages(t).select(F.col("channel").alias("group_title"), F.col("message_id").alias("post_id"), "published_at", "text",
                           F.concat(F.lit("u"), F.col("message_id").cast("string")).alias("post_url"))
    return posts.group_post_text(m)


# --- nested payloads ---------------------------------------------------------------------------------

def answers(t):
    """documents, whole texts, as model answers: one JSON section per document, some fenced, some inside prose, some cut off.

    Every line is a paragraph; the lead is the start of the text, the subsection has the text in one piece and a bullet for each line.
    """
    # cleaned texts are used several times below, so they are computed once
    i = stage(items(t).select("item_id", "source_id", "url", "title", "snippet", "content_text", normalize_text(F.col("content_text")).alias("whole")), "heads")
    k = F.col("item_id")
    lines = F.split(F.coalesce("content_text", F.lit("")), "\n")
    bullet = lambda text: F.struct(F.concat(F.lit("b "), F.get(F.split(text, " "), F.lit(0))).alias("text"),
                                   F.array(F.struct(F.lit("src").alias("label"), F.col("url").alias("url"))).alias("citations"))
    sub = F.struct(F.concat(F.lit("\U0001F680 T"), (k % 3).cast("string")).alias("title"), F.array(F.col("whole"), F.lit(" ")).alias("paragraphs"),
                   F.transform(lines, bullet).alias("bullets"))
    # objects and plain strings in one list
    mixed = F.array(F.to_variant_object(bullet(F.col("title"))), F.parse_json(F.lit('" plain \u2726"')))
    body = F.to_json(F.struct(
        F.when(k % 4 != 0, F.concat(F.lit("H"), k.cast("string"))).alias("headline"), F.col("snippet").alias("lead"), F.concat(lines, F.array(F.lit(" "))).alias("paragraphs"),
        mixed.alias("bullets"), F.array(sub).alias("subsections"), F.concat(F.lit("C"), k.cast("string")).alias("closing")))
    raw = (F.when(k % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 5 == 1, F.concat(F.lit("Вот ответ: "), body, F.lit(" конец")))
           .when(k % 5 == 2, F.substring(body, 2, 20)).otherwise(body))
    return i.select("item_id", "source_id", raw.alias("raw"))


def _tidy(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{FE00}}-\x{{FEFF}}]+', '', 'g'), '^{WS}|{WS}$', '', 'g')"


ANSWERS = f"""{ITEMS}, lines AS (SELECT *, string_split(coalesce(content_text, ''), chr(10)) AS l, {NORM.replace('text', 'content_text')} AS whole FROM items),
parsed AS (SELECT item_id, source_id, CASE WHEN item_id % 4 <> 0 THEN 'H' || item_id END AS headline, nullif({_tidy('snippet')}, '') AS lead,
  list_filter(list_transform(l, lambda x: {_tidy('x')}), lambda x: x <> '') AS ps, {_tidy("'b ' || split_part(title, ' ', 1)")} AS b1, url,
  {_tidy('whole')} AS sp, list_transform(l, lambda x: {_tidy("'b ' || split_part(x, ' ', 1)")}) AS sb, 'T' || (item_id % 3) AS st, 'C' || item_id AS closing
  FROM lines WHERE item_id % 5 <> 2),
own AS (SELECT item_id, source_id, 'paragraph' AS kind, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS pos FROM parsed
  UNION ALL SELECT item_id, source_id, 'bullet', b1, 0 FROM parsed UNION ALL SELECT item_id, source_id, 'bullet', 'plain', 1 FROM parsed),
below AS (SELECT item_id, source_id, st, 'paragraph' AS kind, sp AS text, 0 AS pos FROM parsed WHERE sp <> ''
  UNION ALL SELECT item_id, source_id, st, 'bullet', unnest(sb), generate_subscripts(sb, 1) - 1 FROM parsed)"""


@query("parse_sections", f"""
WITH {ANSWERS} SELECT item_id, headline, lead, array_to_string(ps, '|') AS paragraphs, b1 || '|plain' AS bullets, '1|0' AS citations, st AS sub_titles, closing FROM parsed""")
def _(t):
    s = payloads.parse_sections(answers(t), "raw").where("section is not null")
    c = F.col("section")
    return s.select("item_id", c["headline"].alias("headline"), c["lead"].alias("lead"), joined(c["paragraphs"]).alias("paragraphs"),
                    joined(c["bullets"]["text"]).alias("bullets"), joined(F.transform(c["bullets"], lambda b: F.size(b["citations"]))).alias("citations"),
                    joined(c["subsections"]["title"]).alias("sub_titles"), c["closing"].alias("closing"))


@query("normalize_sections", f"""
WITH {ANSWERS} SELECT item_id, headline, array_to_string(ps, '|') AS paragraphs, '1' AS subs FROM parsed""")
def _(t):
    s = payloads.normalize_sections(payloads.parse_sections(answers(t), "raw").where("section is not null"))
    c = F.col("section")
    return s.select("item_id", c["headline"].alias("headline"), joined(c["paragraphs"]).alias("paragraphs"), F.size(c["subsections"]).cast("string").alias("subs"))


def section_parts(t):
    return stage(payloads.parse_sections(answers(t), "raw").select("source_id", F.col("item_id").alias("part_no"), "section"), "parts")


@query("merge_sections", f"""
WITH {ANSWERS} SELECT source_id, kind, text, item_id AS part_no FROM own QUALIFY row_number() OVER (PARTITION BY source_id, kind, CASE WHEN kind = 'bullet' THEN substr(lower(text), 1, 160) ELSE text END ORDER BY item_id, pos) = 1""")
def _(t):
    return payloads.merge_sections(section_parts(t), ["source_id"]).select("source_id", "kind", "text", "part_no")


@query("section_heads", f"""
WITH {ANSWERS} SELECT source_id, count(*) AS parts, coalesce(arg_min(coalesce(headline, ''), item_id).nullif(''), 'Общие новости') AS headline, arg_min(coalesce(lead, ''), item_id).nullif('') AS lead, arg_max(closing, item_id) AS closing
FROM parsed GROUP BY 1""")
def _(t):
    return payloads.section_heads(section_parts(t), ["source_id"])


@query("flat_draft", f"""
WITH {ANSWERS}, rows AS (SELECT source_id, item_id, kind, text, 0 AS late, pos FROM own UNION ALL SELECT source_id, item_id, kind, text, 1, pos FROM below)
SELECT source_id, kind, text, item_id AS part_no FROM rows QUALIFY row_number() OVER (PARTITION BY source_id, kind, CASE WHEN kind = 'bullet' THEN substr(lower(text), 1, 160) ELSE text END ORDER BY late, item_id, pos) = 1""")
def _(t):
    return payloads.merge_sections(section_parts(t), ["source_id"], drafts=True).select("source_id", "kind", "text", "part_no")


def theme_parts(t):
    first = keep_first(items(t).select("source_id", "item_id"), ["source_id"], ["item_id"]).withColumnRenamed("item_id", "first_id")
    p = stage(payloads.parse_sections(answers(t), "raw"), "parts").join(first, "source_id")
    return p.select("source_id", (F.col("item_id") - F.col("first_id")).alias("position"), F.concat(F.lit("Theme "), F.col("item_id").cast("string")).alias("title"), "section")


@query("assemble_subsections", f"""
WITH {ANSWERS}, f AS (SELECT source_id, min(item_id) AS first_id FROM items GROUP BY 1)
SELECT source_id, coalesce(max(CASE WHEN item_id = first_id THEN headline END), 'Общие новости') AS headline, max(CASE WHEN item_id = first_id THEN lead END) AS lead,
  arg_max(closing, item_id) AS closing, count(*) AS subsections FROM parsed JOIN f USING (source_id) GROUP BY 1""")
def _(t):
    return payloads.assemble_subsections(theme_parts(t), ["source_id"])[0]


@query("assemble_subsection_rows", f"""
WITH {ANSWERS} SELECT source_id, 'Theme ' || item_id AS sub_title, kind, text FROM own""")
def _(t):
    return payloads.assemble_subsections(theme_parts(t), ["source_id"])[1].select("source_id", "sub_title", "kind", "text")


@query("merge_time_parts", f"""
WITH {ANSWERS} SELECT source_id, item_id AS part_no, 'part ' || item_id AS sub_title, kind, text FROM own
UNION ALL SELECT source_id, item_id, st, kind, text FROM below""")
def _(t):
    p = section_parts(t).withColumn("label", F.concat(F.lit("part "), F.col("part_no").cast("string")))
    return payloads.merge_time_parts(p, ["source_id"]).select("source_id", "part_no", "sub_title", "kind", "text")


@query("sections_to_text", f"""
WITH {ANSWERS} SELECT item_id, array_to_string(list_filter(list_concat([headline, lead], ps, ['- ' || b1 || ' [src](' || url || ')', '- plain', '### ' || st, nullif(sp, '')],
  list_transform(sb, lambda x: '- ' || x || ' [src](' || url || ')'), [closing]), lambda x: x IS NOT NULL), chr(10) || chr(10)) AS text FROM parsed""")
def _(t):
    s = payloads.parse_sections(answers(t), "raw").where("section is not null")
    return payloads.sections_to_text(s).select("item_id", "text")


@query("section_quality", f"""
WITH {ANSWERS} SELECT item_id, length(coalesce(lead, '')) >= 180 AND length(sp) >= 200 AS strict, length(coalesce(lead, '')) >= 180 AND length(sp) >= 200 AND len(sb) >= 6 AS six FROM parsed""")
def _(t):
    s = payloads.parse_sections(answers(t), "raw").where("section is not null")
    q = payloads.section_quality(s, min_bullets=1).withColumnRenamed("is_analytical", "strict")
    return payloads.section_quality(q).select("item_id", "strict", F.col("is_analytical").alias("six"))


CITED = 2000  # cited pages; neighbouring facts share one, so facts form chains


@query("missing_facts", f"""
WITH RECURSIVE {ITEMS}, lines AS (SELECT item_id, source_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT item_id, source_id, string_split(coalesce(content_text, ''), chr(10)) AS l FROM items)),
facts AS (
  SELECT source_id AS report_id, item_id * 1000000 + pos AS fact_no, row_number() OVER (PARTITION BY source_id ORDER BY item_id, pos) AS k,
    list_concat(['t:' || substr(lower(line), 1, 160)],
      CASE WHEN item_id % 4 = 3 OR pos > 0 THEN [] ELSE ['u:https://c.example/' || (item_id // 30 % {CITED}), 'u:https://c.example/' || ((item_id // 30 + item_id % 3) % {CITED})] END) AS keys
  FROM lines WHERE trim(line) <> ''),
told AS (SELECT list('t:' || substr(lower(substr({NORM}, 1, 120)), 1, 160)) || ['u:https://c.example/1'] AS keys FROM benchmark),
walk AS (
  SELECT report_id, 0 AS k, keys AS seen, CAST(NULL AS BIGINT) AS fact_no, false AS ok FROM (SELECT DISTINCT report_id FROM facts), told
  UNION ALL
  SELECT f.report_id, f.k, CASE WHEN list_has_any(seen, f.keys) THEN seen ELSE list_concat(seen, f.keys) END, f.fact_no, NOT list_has_any(seen, f.keys)
  FROM walk w JOIN facts f ON f.report_id = w.report_id AND f.k = w.k + 1)
SELECT report_id, fact_no FROM walk WHERE ok""")
def _(t):
    """Every line of a document is a fact; the first one cites pages."""
    from ..functions.text import item_title
    page = F.floor(F.col("item_id") / 30)
    cite = lambda n: F.struct(F.lit("page").alias("label"), F.concat(F.lit("https://c.example/"), (n % CITED).cast("string")).alias("url"))
    none = F.expr(f"cast(array() as array<{payloads.CITATION}>)")
    cited = F.when((F.col("item_id") % 4 == 3) | (F.col("pos") > 0), none).otherwise(F.array(cite(page), cite(page + F.col("item_id") % 3)))
    lines = items(t).select("source_id", "item_id", F.posexplode(F.split(F.coalesce("content_text", F.lit("")), "\n")).alias("pos", "text"))
    drafts = lines.where(F.trim("text") != "").select(F.col("source_id").alias("report_id"), (F.col("item_id") * 1_000_000 + F.col("pos")).alias("fact_no"),
                                                      "text", cited.alias("citations"))
    reports = items(t).groupBy().agg(F.collect_set("source_id").alias("ids"))  # a report per source: a handful
    told = t.benchmark.select(item_title(F.col("text")).alias("text"), none.alias("citations"))
    told = told.unionByName(t.benchmark.groupBy().agg(F.lit("").alias("text"), F.first(F.array(cite(F.lit(1)))).alias("citations")))
    # the same summary stands for every report
    summary = told.withColumn("_all", F.lit(1)).join(F.broadcast(reports.withColumn("_all", F.lit(1))), "_all").select(
        F.explode("ids").alias("report_id"), "text", "citations")
    return payloads.missing_facts(drafts, summary).select("report_id", "fact_no")
