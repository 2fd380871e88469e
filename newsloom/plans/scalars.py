"""Queries over column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, fingerprint, keywords, numbers, text, urls
from ..operators import clusters, sections
from ..sources import html as web
from .registry import joined, query, ts_text
from .views import ITEMS, LABEL_DATES, MONTHS_SQL, NORM, SOURCES, TAG_TEXT, WS, items, label_sql, norm_sql, sources, ts_sql

URL_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
CANON_SQL = f"""
  lower(CASE WHEN regexp_extract(u, '{URL_SPLIT}', 1) = '' THEN 'http' ELSE regexp_extract(u, '{URL_SPLIT}', 1) END)
  || '://' || lower(regexp_extract(u, '{URL_SPLIT}', 2)) || regexp_extract(u, '{URL_SPLIT}', 3)
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END"""
CANON_KEPT = f"""list_transform(list_filter(string_split(regexp_extract(u, '{URL_SPLIT}', 4), '&'),
    lambda p: p <> '' AND NOT starts_with(lower(url_decode(replace(split_part(p, '=', 1), '+', ' '))), 'utm_')),
    lambda p: replace(url_encode(url_decode(replace(split_part(p, '=', 1), '+', ' '))), '%20', '+') || '='
      || replace(url_encode(url_decode(replace(substr(p, length(split_part(p, '=', 1)) + 2), '+', ' '))), '%20', '+'))"""


@query("canonicalize_url", f"""
SELECT page_id, {CANON_SQL} AS canonical_url FROM (
  SELECT page_id, u, {CANON_KEPT} AS kept FROM (SELECT page_id, trim(url) AS u FROM pages))""")
def _(t):
    return t.pages.select("page_id", urls.canonicalize_url(F.col("url")).alias("canonical_url"))


@query("host_key", rf"""
SELECT page_id, coalesce(nullif(regexp_extract(lower(url), '^[a-z]+://(?:[^/@]*@)?([^/:?#]*)', 1), ''), 'unknown') AS host FROM pages""")
def _(t):
    return t.pages.select("page_id", urls.host_key(F.col("url")).alias("host"))


@query("normalize_text", f"SELECT doc_id, {NORM} AS norm FROM documents")
def _(t):
    return t.documents.select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query("text_sha256", f"SELECT doc_id, CASE WHEN {NORM} <> '' THEN sha256({NORM}) END AS text_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", text.text_sha256(F.col("text")).alias("text_hash"))


SIMHASH_CTE = f"""toks AS (
  SELECT doc_id, tok, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower({NORM}), '[0-9A-Za-zА-Яа-яЁё]{{3,}}')) AS tok FROM documents) GROUP BY ALL),
hashed AS (SELECT tok, ('0x' || substr(md5(tok), 17, 16))::UBIGINT AS h FROM (SELECT DISTINCT tok FROM toks)),
votes AS (
  SELECT doc_id, b.i AS i, sum(CASE WHEN (h >> b.i) & 1::UBIGINT = 1 THEN n ELSE -n END) AS v
  FROM toks JOIN hashed USING (tok), (SELECT unnest(range(64))::UBIGINT AS i) b GROUP BY ALL),
hashes AS (
  SELECT doc_id, bit_or(CASE WHEN v >= 0 THEN 1::UBIGINT << i ELSE 0::UBIGINT END) AS u FROM votes GROUP BY ALL),
simhashes AS (
  SELECT d.doc_id, CASE WHEN {NORM} = '' THEN NULL WHEN u IS NULL THEN 0
    WHEN u >= 9223372036854775808::UBIGINT THEN (u::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE u::BIGINT END AS simhash64
  FROM documents d LEFT JOIN hashes USING (doc_id))"""


@query("simhash64", f"WITH {SIMHASH_CTE} SELECT doc_id, simhash64 FROM simhashes")
def _(t):
    d = t.documents.select(F.col("doc_id"), F.col("text").alias("content_text"))
    return clusters.with_simhash(d).select("doc_id", "simhash64")


@query("hamming64", f"""
WITH {SIMHASH_CTE} SELECT doc_id, bit_count(xor(simhash64, 81985529216486895)) AS distance FROM simhashes WHERE simhash64 IS NOT NULL""")
def _(t):
    d = clusters.with_simhash(t.documents.select("doc_id", F.col("text").alias("content_text")))
    return d.where("simhash64 is not null").select(
        "doc_id", fingerprint.hamming64(F.col("simhash64"), F.lit(0x0123456789ABCDEF)).alias("distance"))


@query("head_chars", f"SELECT doc_id, substr({NORM}, 1, 120) AS title, substr({NORM}, 1, 300) AS snippet FROM documents")
def _(t):
    return t.documents.select("doc_id", text.item_title(F.col("text")).alias("title"), text.item_snippet(F.col("text")).alias("snippet"))


@query("period_month", """
SELECT event_id, strftime(date_trunc('month', coalesce(CASE WHEN event_type <> 'view' THEN ts END, TIMESTAMP '2023-12-15 00:00:00')), '%Y-%m-%d') AS month
FROM events""")
def _(t):
    ts = F.when(F.col("event_type") != "view", F.col("ts"))
    return t.events.select("event_id", dates.period_month(ts, F.lit("2023-12-15").cast("timestamp_ntz")).cast("string").alias("month"))


@query("parse_keyword_list", r"""
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name || ',' || p_type || '; ' || p_brand), '[,;\s]+'), lambda x: x <> ''), '|') AS words,
  array_to_string(list_filter([trim(lower(p_name)), trim(lower(p_type)), ''], lambda x: x <> ''), '|') AS listed FROM part""")
def _(t):
    return t.part.select(
        "p_partkey", joined(keywords.parse_keyword_text(F.concat("p_name", F.lit(","), "p_type", F.lit("; "), "p_brand"))).alias("words"),
        joined(keywords.parse_keyword_list(F.array(F.concat(F.lit(" "), "p_name"), "p_type", F.lit("  ")))).alias("listed"))


@query("tagging_text", rf"""
SELECT doc_id, {TAG_TEXT.format("'see https://a.b/c?d www.e.f/g ' || text")} AS tag_text FROM documents""")
def _(t):
    return t.documents.select("doc_id", text.tagging_text(F.concat(F.lit("see https://a.b/c?d www.e.f/g "), "text")).alias("tag_text"))


@query("clean_post_text", rf"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(
    text || chr(10) || 'Подпишитесь на MAX ' || chr(128640) || chr(10) || '  ok ' || chr(10022), '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{FE00}}-\x{{FEFF}}]+', '', 'g'),
    '\r\n|[\n\x0b\f\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: regexp_replace(l, '^{WS}|{WS}$', '', 'g')),
    lambda l: l <> '' AND NOT (regexp_matches(l, '(?i)подпишитесь|подписывайтесь|подписаться') AND regexp_matches(l, '(?i)ерз|max'))),
    chr(10) || chr(10)) AS cleaned FROM documents""")
def _(t):
    c = F.concat("text", F.lit("\nПодпишитесь на MAX \U0001F680\n  ok ✦"))
    return t.documents.select("doc_id", text.clean_post_text(c).alias("cleaned"))


@query("parse_iso_ts", f"""
SELECT event_id, {ts_sql("date_trunc('second', ts)")} AS with_zone, {ts_sql("date_trunc('day', ts)")} AS day_only,
  {ts_sql("date_trunc('second', ts) - INTERVAL 3 HOUR")} AS moscow, CAST(NULL AS VARCHAR) AS invalid FROM events""")
def _(t):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t.events.select(
        "event_id", ts_text(dates.parse_iso_ts(F.concat(iso, F.lit("Z")))).alias("with_zone"),
        ts_text(dates.parse_iso_ts(F.substring(iso, 1, 10))).alias("day_only"),
        ts_text(dates.parse_iso_ts(F.concat(iso, F.lit("+0300")))).alias("moscow"),
        ts_text(dates.parse_iso_ts(F.concat(F.lit("on "), iso))).alias("invalid"))


@query("epoch_auto", f"""
SELECT event_id, {ts_sql("date_trunc('second', ts)")} AS from_seconds, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') AS from_millis,
  {ts_sql("date_trunc('day', ts)")} AS from_text FROM events""")
def _(t):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select(
        "event_id", ts_text(dates.epoch_auto(s.cast("string"))).alias("from_seconds"),
        F.date_format(dates.epoch_auto(ms.cast("string")), "yyyy-MM-dd HH:mm:ss.SSS").alias("from_millis"),
        ts_text(dates.epoch_auto(F.date_format("ts", "yyyy-MM-dd"))).alias("from_text"))


@query("period_label", f"SELECT o_orderkey, {label_sql('o_orderdate')} AS label FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dates.period_label(F.col("o_orderdate")).alias("label"))


@query("period_sort_key", f"""
WITH {LABEL_DATES}
SELECT o_orderkey, kind, CASE WHEN unknown THEN 9999 ELSE year(d) END AS y,
  CASE WHEN unknown THEN 99 WHEN kind = 'year' THEN 1 ELSE month(d) END AS m,
  CASE WHEN unknown THEN 99 WHEN kind = 'full' THEN day(d) WHEN kind = 'range' THEN day(d) WHEN kind = 'iso' THEN day(d) ELSE 1 END AS d
FROM (SELECT *, kind = 'word' OR (kind = 'short' AND month(d) = 8) AS unknown FROM labels_of)""")
def _(t):
    from .views import labels_of
    k = F.col("k")
    return labels_of(t).withColumn("k", dates.period_sort_key(F.col("label"))).select(
        "o_orderkey", "kind", k["y"].alias("y"), k["m"].alias("m"), k["d"].alias("d"))


@query("month_bounds", f"""
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_text, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last_text
FROM orders WHERE year(o_orderdate) BETWEEN 2000 AND 2100""")
def _(t):
    b = t.orders.select("o_orderkey", dates.month_bounds(F.date_format("o_orderdate", "yyyy-MM")).alias("b"))
    return b.where("b is not null").select("o_orderkey", F.col("b.date_from").cast("string").alias("month_text"),
                                           F.col("b.date_to").cast("string").alias("last_text"))


@query("month_bounds_shifted", """
SELECT o_orderkey, strftime(date_trunc('month', d), '%Y-%m-%d') AS month_text, strftime(last_day(d), '%Y-%m-%d') AS last_text
FROM (SELECT o_orderkey, o_orderdate + INTERVAL 10 YEAR AS d FROM orders) WHERE year(d) BETWEEN 2000 AND 2100""")
def _(t):
    shifted = F.add_months(F.trunc("o_orderdate", "MM"), 120)
    b = t.orders.select("o_orderkey", dates.month_bounds(F.date_format(shifted, "yyyy-MM")).alias("b"))
    return b.where("b is not null").select("o_orderkey", F.col("b.date_from").cast("string").alias("month_text"),
                                           F.col("b.date_to").cast("string").alias("last_text"))


@query("serial_or_date_label", f"""
SELECT o_orderkey, {label_sql('o_orderdate')} AS from_serial, {label_sql('o_orderdate')} AS from_date, o_orderpriority AS from_text FROM orders""")
def _(t):
    day = F.to_date("o_orderdate")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("double") + 0.25
    no_n, no_d, no_t = (F.lit(None).cast(x) for x in ("double", "date", "string"))
    return t.orders.select(
        "o_orderkey", dates.serial_or_date_label(serial, no_d, no_t).alias("from_serial"),
        dates.serial_or_date_label(no_n, day, no_t).alias("from_date"),
        dates.serial_or_date_label(no_n, no_d, F.concat(F.lit(" "), "o_orderpriority", F.lit("\n"))).alias("from_text"))


@query("parse_value_change", r"""
SELECT c_custkey, CAST(replace(nullif(regexp_extract(s, '(\d{1,3}(?:[,.]\d{1,6})?)', 1), ''), ',', '.') AS DOUBLE) AS value,
  TRY_CAST(replace(nullif(regexp_extract(s, '\(([+-]?[\d,.]+)\s*(?:%|п\.п\.?)\)', 1), ''), ',', '.') AS DOUBLE) AS change_pct
FROM (SELECT c_custkey, replace(CAST(abs(c_nationkey) * 7 + 0.5 AS VARCHAR), '.', ',') || ' (' || CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END
  || (c_custkey % 90) || ',25 ' || CASE WHEN c_custkey % 3 = 0 THEN 'п.п.)' ELSE '%)' END AS s FROM customer)""")
def _(t):
    k = F.col("c_custkey")
    cell = F.concat(F.replace((F.abs("c_nationkey") * 7 + F.lit(0.5)).cast("string"), F.lit("."), F.lit(",")), F.lit("\n("),
                    F.when(k % 2 == 0, "+").otherwise("-"), (k % 90).cast("string"), F.lit(",25 "),
                    F.when(k % 3 == 0, "п.п.)").otherwise("%)"))
    return t.customer.select(k, numbers.parse_value_change(cell).alias("v")).select(k, "v.value", "v.change_pct")


@query("rate_value", r"""
SELECT o_orderkey, CAST(replace(nullif(regexp_extract(s, '(?:^|\D)(\d{1,2}[,.]\d{1,2}|\d{1,2})(?:\D|$)', 1), ''), ',', '.') AS DOUBLE) AS rate
FROM (SELECT o_orderkey, 'в ' || year(o_orderdate) || ' г. ' || (o_custkey % 40) || ',5 или ' || o_orderkey AS s FROM orders)""")
def _(t):
    s = F.concat(F.lit("в "), F.year("o_orderdate").cast("string"), F.lit(" г. "), (F.col("o_custkey") % 40).cast("string"),
                 F.lit(",5 или "), F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", numbers.rate_value(s).alias("rate"))


@query("source_label", f"""
WITH {SOURCES}
SELECT source_id, coalesce(nullif(name, ''), nullif(base_url, ''), nullif(feed_url, ''), '@' || nullif(tg_channel_username, ''), source_id) AS label,
  coalesce(nullif(name, ''), nullif(base_url, ''), nullif(feed_url, ''), '@' || nullif(tg_channel_username, '')) AS short_label FROM sources""")
def _(t):
    return sources(t).select("source_id", sections.source_label().alias("label"), sections.source_label(False).alias("short_label"))


@query("md_links", r"""
SELECT page_id, array_to_string(regexp_extract_all(s, '\[([^\]]+)\]\((https?://[^)\s]+)\)', 1), '|') AS labels,
  array_to_string(regexp_extract_all(s, '\[([^\]]+)\]\((https?://[^)\s]+)\)', 2), '|') AS urls
FROM (SELECT page_id, 'a [p' || page_id || '](' || url || ') and [next](' || url || '1) [no](ftp://x)' AS s FROM pages)""")
def _(t):
    s = F.concat(F.lit("a [p"), F.col("page_id").cast("string"), F.lit("]("), "url", F.lit(") and [next]("), "url", F.lit("1) [no](ftp://x)"))
    links = t.pages.select("page_id", text.md_links(s).alias("l"))
    return links.select("page_id", joined(F.col("l.label")).alias("labels"), joined(F.col("l.url")).alias("urls"))


@query("classify_error", """
SELECT event_id, CASE k % 9 WHEN 0 THEN 'not_configured' WHEN 1 THEN 'connection' WHEN 2 THEN 'unauthorized' WHEN 3 THEN 'unauthorized'
  WHEN 4 THEN 'missing_keys' WHEN 5 THEN 'flood' WHEN 6 THEN 'not_found' WHEN 7 THEN 'no_access' ELSE CASE WHEN k % 2 = 0 THEN 'other' END END AS category
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    said = ["Telegram Credentials not configured.", "Connection to Telegram failed 5 times", "Session is not authorized",
            "Telegram: not authorized", "api_id и api_hash обязательны", "FloodWait 30s", "Username not occupied by anyone",
            "Could not find the input entity for PeerUser"]
    raw = F.when(k % 9 < 8, F.get(F.lit(said), k % 9)).when(k % 2 == 0, F.lit("boom")).otherwise(F.lit("  "))
    return t.events.select("event_id", text.classify_error(raw).alias("category"))


@query("classify_fact", f"""
WITH {ITEMS}
SELECT item_id, CASE WHEN regexp_matches(h, 'sale|ention') AND contains(h, 'sale') THEN 'Маркетинг и продажи'
  WHEN contains(h, 'gost') THEN 'Репутация и риски' ELSE 'Продукт и ассортимент' END AS section
FROM (SELECT item_id, lower(content_text) AS h FROM items)""")
def _(t):
    return items(t).select("item_id", text.classify_fact(F.col("content_text")).alias("section"))


@query("html_to_text", rf"""
SELECT page_id, {norm_sql("replace(replace(replace(replace(replace(replace(replace(bare, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&nbsp;', chr(160)), '&amp;', '&')")} AS page_text
FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
  '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'),
  '(?s)<[/!?]?[A-Za-z][^>]*>|<[!?][^>]*>', ' ', 'g') AS bare FROM pages)""")
def _(t):
    return t.pages.select("page_id", web.html_to_text(F.col("html")).alias("page_text"))


@query("ordered_union", """
SELECT p_partkey, array_to_string([p_brand] || list_filter([p_type, lower(p_brand), 'x'], lambda x: x <> p_brand), '|') AS words FROM part""")
def _(t):
    both = keywords.ordered_union(F.array("p_brand", "p_type"), F.array("p_brand", F.lower("p_brand"), "p_type", F.lit("x")))
    return t.part.select("p_partkey", joined(both).alias("words"))


@query("meta_ts", f"""SELECT event_id, {ts_sql("date_trunc('second', ts)")} AS updated_at, CAST(NULL AS VARCHAR) AS missing FROM events""")
def _(t):
    from ..operators.payloads import meta_ts
    meta = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"), F.col("props").alias("p")))
    return t.events.select("event_id", ts_text(meta_ts(meta, "$.updated_at")).alias("updated_at"),
                           ts_text(meta_ts(meta, "$.p")).alias("missing"))
