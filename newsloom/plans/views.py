"""Driver tables in the shape of the data model, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import item_snippet, item_title
from .registry import Tables

# Unicode whitespace, spelled out for RE2.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}', ' ', 'g'))"


def ts_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


NORM = norm_sql("text")
ITEM_START = 1704067200  # 2024-01-01 00:00:00 UTC
ITEM_STEP = 37 * 60


def items(t: Tables) -> DataFrame:
    """documents as items."""
    published = F.timestamp_seconds(F.lit(ITEM_START) + F.col("doc_id") * ITEM_STEP)
    return t.documents.select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("source_id"), "lang",
        F.concat(F.lit("https://news.example/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        item_title(F.col("text")).alias("title"), item_snippet(F.col("text")).alias("snippet"),
        F.col("text").alias("content_text"), published.alias("published_at"),
        F.timestamp_seconds(F.lit(ITEM_START) + F.col("doc_id") * ITEM_STEP + 600).alias("created_at"),
        F.trunc(published, "MM").alias("period_month"))


ITEMS = f"""items AS (
  SELECT doc_id AS item_id, source AS source_id, lang,
         'https://news.example/' || source || '/' || doc_id AS url,
         substr({NORM}, 1, 120) AS title, substr({NORM}, 1, 300) AS snippet, text AS content_text,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 37) AS published_at,
         TIMESTAMP '2024-01-01 00:10:00' + to_minutes(doc_id * 37) AS created_at,
         date_trunc('month', TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 37))::DATE AS period_month
  FROM documents)"""


def sources(t: Tables) -> DataFrame:
    """One source per distinct documents.source, with settings derived from its number."""
    n = F.col("n")
    ids = t.documents.select(F.col("source").alias("source_id")).distinct().withColumn(
        "n", F.regexp_extract("source_id", r"(\d+)$", 1).cast("int"))
    text = "cast(null as string)"
    return ids.select(
        "source_id", "n",
        F.when(n % 4 != 0, F.concat(F.lit("Source "), n.cast("string"))).otherwise(F.expr(text)).alias("name"),
        F.when(n % 8 != 0, F.concat(F.lit("https://"), "source_id", F.lit(".example"))).otherwise(F.lit("")).alias("base_url"),
        F.when(n % 16 != 0, F.concat(F.lit("https://"), "source_id", F.lit(".example/feed"))).otherwise(F.expr(text)).alias("feed_url"),
        F.concat(F.lit("chan"), n.cast("string")).alias("tg_channel_username"),
        F.element_at(F.array(*[F.lit(x) for x in ("RSS_ATOM", "SITEMAP", "TELEGRAM_CHANNEL")]), n % 3 + 1).alias("source_type"),
        F.when(n % 3 == 0, n % 5 + 1).otherwise(F.lit(None)).cast("int").alias("competitor_id"),
        F.when(n % 4 == 1, n % 3 + 1).otherwise(F.lit(None)).cast("int").alias("developer_id"),
        F.when(n % 2 == 0, F.array((n % 4 + 1).cast("string"))).when(n % 5 == 0, F.expr("cast(array() as array<string>)"))
        .otherwise(F.array(F.lit("1"), F.lit("2"))).alias("region_tags"),
        (n % 7 != 0).alias("enabled"), (n % 3).alias("priority"), (F.lit(30) + n % 4 * 10).alias("fetch_frequency_min"),
        F.when(n % 3 == 1, F.array(F.lit(" The"), F.lit("reation"))).otherwise(F.expr("cast(array() as array<string>)")).alias("include_keywords"),
        F.when(n % 2 == 1, F.array(F.lit("eauon"), F.lit("HEND"))).otherwise(F.expr("cast(array() as array<string>)")).alias("exclude_keywords"),
        (n % 4 == 2).alias("match_whole_words"))


SOURCES = """sources AS (
  SELECT source_id, n,
         CASE WHEN n % 4 <> 0 THEN 'Source ' || n END AS name,
         CASE WHEN n % 8 <> 0 THEN 'https://' || source_id || '.example' ELSE '' END AS base_url,
         CASE WHEN n % 16 <> 0 THEN 'https://' || source_id || '.example/feed' END AS feed_url,
         'chan' || n AS tg_channel_username,
         ['RSS_ATOM', 'SITEMAP', 'TELEGRAM_CHANNEL'][n % 3 + 1] AS source_type,
         CASE WHEN n % 3 = 0 THEN n % 5 + 1 END AS competitor_id,
         CASE WHEN n % 4 = 1 THEN n % 3 + 1 END AS developer_id,
         CASE WHEN n % 2 = 0 THEN [CAST(n % 4 + 1 AS VARCHAR)] WHEN n % 5 = 0 THEN []::VARCHAR[] ELSE ['1', '2'] END AS region_tags,
         n % 7 <> 0 AS enabled, n % 3 AS priority, 30 + n % 4 * 10 AS fetch_frequency_min,
         CASE WHEN n % 3 = 1 THEN ['the', 'reation'] ELSE []::VARCHAR[] END AS include_words,
         CASE WHEN n % 2 = 1 THEN ['eauon', 'hend'] ELSE []::VARCHAR[] END AS exclude_words,
         n % 4 = 2 AS match_whole_words
  FROM (SELECT DISTINCT source AS source_id, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) AS n FROM documents))"""


def run_log(t: Tables) -> DataFrame:
    """events as a run log: one run per event, user as source, errors as failures of several kinds."""
    k = F.get_json_object("props", "$.k").cast("int")
    failed = F.col("event_type") == "error"
    return t.events.select(
        F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("run_at"), F.col("event_id").alias("run_id"),
        (~failed).alias("ok"), F.when(failed & (k % 5 == 0), F.lit(429)).otherwise(F.lit(None)).cast("int").alias("http_status"),
        F.when(k % 2 == 0, k + 30).otherwise(F.lit(None)).cast("int").alias("retry_after"),
        F.when(failed, F.when(k % 7 == 0, F.concat(F.lit("FloodWait "), k.cast("string"), F.lit("s")))
               .when(k % 11 == 0, F.lit("Blocked by robots.txt")).otherwise(F.lit("timeout"))).alias("error"))


RUN_LOG = """run_log AS (
  SELECT user_id AS source_id, ts AS run_at, event_id AS run_id, event_type <> 'error' AS ok,
         CASE WHEN event_type = 'error' AND k % 5 = 0 THEN 429 END AS http_status,
         CASE WHEN k % 2 = 0 THEN k + 30 END AS retry_after,
         CASE WHEN event_type = 'error' THEN CASE WHEN k % 7 = 0 THEN 'FloodWait ' || k || 's'
              WHEN k % 11 = 0 THEN 'Blocked by robots.txt' ELSE 'timeout' END END AS error
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""

COMPETITORS = [
    (1, "Reation", ["auou", "nterti"], ["the"], True),
    (2, "Mentre", ["eauon"], [], True),
    (3, "Iering", ["hend"], ["au"], True),
    (4, "La", [], ["el"], True),
    (5, "Erheed", [], ["tion"], False),
]
DEVELOPERS = [
    (1, "Onthsh", [], ["ich"], True),
    (2, "Aulich", ["für"], [], True),
    (3, "Ververs", ["cion"], [], True),
]
REGIONS = [
    (1, "North", ["Reati"], ["the"], [], True),
    (2, "South", ["Mento"], ["que", "город"], ["Eauou"], True),
    (3, "East", [], ["Aulich", "und"], ["der"], True),
    (4, "West", ["Cionado"], ["el"], [], True),
    (5, "Closed", ["tion"], ["and"], [], False),
]


def _entities(t: Tables, rows: list) -> DataFrame:
    return t.spark.createDataFrame(rows, "entity_id int, name string, aliases array<string>, tags array<string>, is_active boolean")


def competitors(t: Tables) -> DataFrame:
    return _entities(t, COMPETITORS)


def developers(t: Tables) -> DataFrame:
    return _entities(t, DEVELOPERS)


def regions(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(REGIONS, "region_id int, name string, federal_subjects array<string>, "
                                            "keywords array<string>, geographic_aliases array<string>, is_active boolean")


def _terms_sql(name: str, rows: list, first: int) -> str:
    values, no = [], 0
    for row in rows:
        words = ([row[1]] if first == 2 else []) + [w for part in row[2:-1] for w in part]
        for w in words:
            no += 1
            values.append(f"({row[0]}, '{row[1]}', '{w.lower()}', {no}, {'true' if row[-1] else 'false'})")
    return f"{name}(entity_id, name, term, term_no, is_active) AS (VALUES {', '.join(values)})"


COMPETITOR_TERMS = _terms_sql("competitor_terms", COMPETITORS, 2)
DEVELOPER_TERMS = _terms_sql("developer_terms", DEVELOPERS, 2)
REGION_TERMS = _terms_sql("region_terms", REGIONS, 3)


def names_sql(name: str, rows: list) -> str:
    values = ", ".join(f"({r[0]}, '{r[1]}', {'true' if r[-1] else 'false'})" for r in rows)
    return f"{name}(entity_id, name, is_active) AS (VALUES {values})"


TAG_TEXT = r"lower(regexp_replace({0}, '(?i)https?://[^\s\x0b\x1c-\x1f\x{{A0}}]+|www\.[^\s\x0b\x1c-\x1f\x{{A0}}]+', ' ', 'g'))"


def hit_sql(text: str, term: str) -> str:
    """Whole-word match of short terms, substring match of longer ones."""
    return (f"CASE WHEN length({term}) <= 3 THEN regexp_matches({text}, '(^|[^a-z0-9а-яё])' || {term} || '([^a-z0-9а-яё]|$)') "
            f"ELSE contains({text}, {term}) END")


def mentions_sql(view: str, terms: str, text: str) -> str:
    """(item_id, entity_id) of the active entities found in the text of each item."""
    return f"""{view} AS (
  SELECT DISTINCT i.item_id, e.entity_id
  FROM (SELECT item_id, {TAG_TEXT.format(text)} AS hay FROM items) i JOIN {terms} e ON e.is_active AND {hit_sql('i.hay', 'e.term')})"""


def indicator_rows(t: Tables) -> DataFrame:
    """lineitem as parsed indicators: return flag as name, month of shipping as period label."""
    from ..functions.dates import period_label
    month = F.trunc(F.col("l_shipdate"), "MM")
    sums = t.lineitem.groupBy(F.col("l_returnflag").alias("indicator_name"), month.alias("m")).agg(
        F.round(F.sum("l_quantity"), 2).alias("value"))
    return sums.select(
        (F.year("m") * 100 + F.month("m")).cast("long").alias("row_id"), "indicator_name",
        period_label(F.col("m")).alias("period"), "value", F.lit("шт").alias("unit"), F.col("m").alias("month"))


MONTHS_SQL = ("['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', "
              "'октября', 'ноября', 'декабря']")


def label_sql(d: str) -> str:
    return f"day({d}) || ' ' || {MONTHS_SQL}[month({d})] || ' ' || year({d}) || ' г.'"


INDICATOR_ROWS = f"""indicator_rows AS (
  SELECT CAST(year(m) * 100 + month(m) AS BIGINT) AS row_id, indicator_name, {label_sql('m')} AS period, value, 'шт' AS unit, m AS month
  FROM (SELECT l_returnflag AS indicator_name, date_trunc('month', l_shipdate)::DATE AS m, round(sum(l_quantity), 2) AS value
        FROM lineitem GROUP BY ALL))"""


def messages(t: Tables) -> DataFrame:
    """conversations as channel posts: the conversation is the album, the role the channel."""
    mid = F.col("conv_id") * 1000 + F.col("turn")
    return t.conversations.select(
        F.col("role").alias("channel"), mid.alias("message_id"), F.col("conv_id").alias("grouped_id"), "text",
        F.timestamp_seconds(F.lit(ITEM_START) + mid * 60).alias("published_at"),
        F.when(F.col("turn") % 2 == 1, F.concat(F.lit("/m/"), mid.cast("string"), F.lit(".jpg"))).otherwise(F.expr("cast(null as string)")).alias("image_path"))


MESSAGES = """messages AS (
  SELECT role AS channel, conv_id * 1000 + turn AS message_id, conv_id AS grouped_id, text,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 1000 + turn) AS published_at,
         CASE WHEN turn % 2 = 1 THEN '/m/' || (conv_id * 1000 + turn) || '.jpg' END AS image_path
  FROM conversations)"""


def labels_of(t: Tables) -> DataFrame:
    """orders with a period label of one of seven kinds."""
    from ..functions.dates import MONTHS_SHORT, period_label
    d, kind = F.to_date("o_orderdate"), F.element_at(F.lit(LABEL_KINDS), (F.col("o_orderkey") % 7 + 1).cast("int"))
    short = F.element_at(F.lit([m.capitalize() for m in MONTHS_SHORT]), F.month(d))
    full = period_label(d)
    year = F.year(d).cast("string")
    label = (F.when(kind == "full", full).when(kind == "range", F.concat(full, F.lit(" - "), period_label(F.date_add(d, 40))))
             .when(kind == "year", year).when(kind == "short", F.concat(short, F.lit(". "), year))
             .when(kind == "iso", d.cast("string")).when(kind == "iso_month", F.date_format(d, "yyyy-MM"))
             .otherwise(F.lit("за весь период")))
    return t.orders.select("o_orderkey", kind.alias("kind"), label.alias("label"))


LABEL_KINDS = ["full", "range", "year", "short", "iso", "iso_month", "word"]
LABEL_DATES = """labels_of AS (
  SELECT o_orderkey, o_orderdate AS d, ['full', 'range', 'year', 'short', 'iso', 'iso_month', 'word'][o_orderkey % 7 + 1] AS kind FROM orders)"""
