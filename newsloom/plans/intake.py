"""Queries over raw payloads, which Spark builds from the driver tables, and over streams of them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonicalize_url
from ..operators.ingest import enrich_items
from ..session import discard, new_path
from ..sources import articles, entries, feeds, html, posts, quotes
from ..streaming import jobs
from .registry import joined, query, ts_text
from .reports import MEMBERS_SQL
from .rows import HEALTH_SQL
from .scalars import CANON_KEPT, CANON_SQL
from .views import ITEM_START, ITEMS, MESSAGES, NORM, competitors, developers, items, messages, regions, run_log, sources, ts_sql

PER_FEED = 20


def xml(c: Column) -> Column:
    """Text made safe for an XML body: markup escaped, control characters left out."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _chunked(rows: DataFrame, row_id: str, line: Column, by: str | None = None) -> DataFrame:
    """Bodies of PER_FEED consecutive rows each: (part, body)."""
    keys = [F.floor(F.col(row_id) / PER_FEED).alias("part"), *([F.col(by)] if by else [])]
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(row_id).alias("id"), line.alias("x")))).alias("r"))
    return g.select("part", *([by] if by else []), F.array_join(F.col("r.x"), "").alias("body"))


def feed_payloads(t) -> DataFrame:
    """documents, whole texts, as feeds of twenty entries: even parts RSS, odd parts Atom, every second Atom feed with prefixes.

    Even items carry their text as full content, odd ones as description or summary; every third Atom content is XHTML. RSS items also have
    elements of other namespaces, HTML entities and bare ampersands, every third one its text in CDATA; each RSS feed has a broken item.
    """
    i = items(t)
    odd = F.floor(F.col("item_id") / PER_FEED) % 2 == 1
    full = F.col("item_id") % 2 == 0
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rfc = F.concat(F.lit("Mon, "), F.date_format("published_at", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    markup = F.concat(F.lit("<p>"), xml(F.coalesce("content_text", F.lit(""))), F.lit("</p>"))

    def tag(name: str, value: Column, attrs: str = "") -> Column:
        return F.concat(F.lit(f"<{name}{attrs}>"), value, F.lit(f"</{name}>"))

    once = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("<![CDATA["), markup, F.lit("]]>"))).otherwise(xml(markup))
    other = '<media:title>other</media:title><atom:link rel="self" href="https://self.example/"/><category>a&nbsp;b & c:d</category><source><title>of</title></source>'
    rss = tag("item", F.concat(
        F.lit(other), tag("title", xml(F.col("title"))), tag("link", F.col("url")),
        F.when(full, F.concat(tag("description", F.lit("short")), tag("content:encoded", once))).otherwise(tag("description", once)),
        tag("itunes:summary", F.lit("spoken")), tag("pubDate", rfc)))
    content = F.when(F.col("item_id") % 3 == 0, tag("content", tag("div", markup), ' type="xhtml"')).otherwise(tag("content", xml(markup), ' type="html"'))
    atom = tag("entry", F.concat(
        tag("title", xml(F.col("title"))), F.lit('<link rel="alternate" href="'), "url", F.lit('"/><id>x</id>'),
        F.when(full, F.concat(tag("summary", F.lit("short")), content)).otherwise(tag("summary", xml(markup), ' type="html"')), tag("updated", iso)))
    body = _chunked(i, "item_id", F.when(odd, atom).otherwise(rss))
    feed = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "body", F.lit("</feed>"))
    prefixed = F.replace(F.regexp_replace(feed, "(</?)([a-z]+)", "$1a:$2"), F.lit("xmlns="), F.lit("xmlns:a="))
    wrapped = F.when(F.col("part") % 4 == 1, F.concat(F.lit('<?xml version="1.0"?>'), feed)).when(F.col("part") % 4 == 3, prefixed).otherwise(
        F.concat(F.lit('<rss version="2.0" xmlns:content="c"><channel><title>t &copy; &</title>'
                       '<item><title>broken <b></title><link>https://broken.example/</link></item>'), "body", F.lit("</channel></rss>")))
    return body.select(F.concat(F.lit("src"), F.col("part").cast("string")).alias("source_id"), F.lit("https://feeds.example/f").alias("url"),
                       wrapped.alias("body"), F.timestamp_seconds(F.lit(ITEM_START) + F.col("part")).alias("fetched_at"))


CLEAN = r"regexp_replace({0}, '[\x01-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"


@query("rss_items", f"""
WITH {ITEMS} SELECT url, trim({CLEAN.format('title')}) AS title, {NORM.replace('text', CLEAN.format('content_text'))} AS content_text, {ts_sql('published_at')} AS published_at FROM items""")
def _(t):
    r = feeds.rss_items(feed_payloads(t))
    return r.select("url", F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("content_text", F.lit("")).alias("content_text"),
                    ts_text(F.col("published_at")).alias("published_at"))


def sitemap_payloads(t) -> DataFrame:
    """pages as sitemaps of twenty urls with a namespace prefix."""
    p = t.pages
    line = F.concat(F.lit("<sm:url><sm:loc> "), xml(F.col("url")), F.lit(" </sm:loc><sm:lastmod>2024-01-"),
                    F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</sm:lastmod></sm:url>"))
    body = _chunked(p, "page_id", line)
    return body.select(
        F.lit("site").alias("source_id"), F.concat(F.lit("https://maps.example/"), F.col("part").cast("string")).alias("url"),
        F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9">'), "body",
                 F.lit("</sm:urlset>")).alias("body"), F.timestamp_seconds(F.lit(ITEM_START)).alias("fetched_at"))


@query("sitemap_urls", """
SELECT url AS loc, strftime(DATE '2024-01-01' + CAST(page_id % 28 AS INT), '%Y-%m-%d') AS lastmod FROM pages WHERE regexp_matches(url, '/(en|fr)/') AND NOT regexp_matches(url, 'utm_')""")
def _(t):
    u = feeds.sitemap_urls(sitemap_payloads(t), include="/(en|fr)/", exclude="utm_", max_urls=None)
    return u.select("loc", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"))


@query("sitemap_urls_capped", """
SELECT url AS loc, (SELECT greatest(count(*) - 45, 0) FROM pages) AS left_out FROM pages ORDER BY 'https://maps.example/' || (page_id // 20), page_id LIMIT 45""")
def _(t):
    return feeds.sitemap_urls(sitemap_payloads(t), max_urls=45).select("loc", "left_out")


@query("expand_sitemap_index", """
WITH n AS (SELECT count(DISTINCT page_id // 20) AS parts FROM pages), x AS (SELECT unnest(range(21)) AS seq)
SELECT 'site' AS source_id, seq, CASE WHEN seq = 0 THEN 'https://maps.example/root' ELSE 'https://maps.example/' || (seq - 1) END AS url FROM x, n WHERE seq <= parts""")
def _(t):
    maps = sitemap_payloads(t)
    children = _chunked(maps.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("part"), "url").withColumn("all", F.lit(0)), "part",
                        F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>")))
    index = children.select(
        F.lit("site").alias("source_id"), F.when(F.col("part") == 0, F.lit("https://maps.example/root")).otherwise(
            F.concat(F.lit("https://maps.example/index"), F.col("part").cast("string"))).alias("url"),
        F.concat(F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "body", F.lit("</sitemapindex>")).alias("body"),
        F.timestamp_seconds(F.lit(ITEM_START)).alias("fetched_at"))
    roots = t.pages.groupBy().agg(F.lit("site").alias("source_id"), F.lit("https://maps.example/root").alias("url"))
    return feeds.expand_sitemap_index(roots, maps.unionByName(index)).select("source_id", "seq", "url")


@query("discover_links", r"""
WITH a AS (SELECT page_id, regexp_replace(url, '^([a-z]+://[^/?#]+).*$', '\1') AS root, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*/)', 1) AS dir, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos FROM (
  SELECT page_id, url, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'),
    '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)"', 1) AS hrefs FROM pages)),
b AS (SELECT page_id, pos, replace(href, '&amp;', '&') AS href, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN replace(href, '&amp;', '&') WHEN starts_with(href, '/') THEN root || replace(href, '&amp;', '&')
  ELSE root || CASE WHEN dir = '' THEN '/' ELSE dir END || replace(href, '&amp;', '&') END AS url FROM a WHERE href <> '')
SELECT page_id, url FROM b QUALIFY row_number() OVER (PARTITION BY page_id, regexp_replace(url, '#.*$', '') ORDER BY pos) = 1""")
def _(t):
    return html.discover_links(t.pages).select("page_id", "url")


TEMPLATE = {"detail": {"title": {"css": "article h1"}, "date": {"css": "html", "attr": "lang"}, "body": {"css": "article"}, "author": {"css": "meta[charset]", "attr": "charset"}},
            "cleanup": {"remove_css": [".ad", "nav"]}, "min_fulltext_length": 1}


def _plain_html(c: str) -> str:
    """Text of a piece of markup: tags out, the entities that occur decoded, whitespace collapsed."""
    bare = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for name, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#x27;", "chr(39)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")):
        bare = f"replace({bare}, '{name}', {char})"
    return NORM.replace("text", bare)


ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 0)"


@query("extract_articles", rf"""
SELECT page_id, url, {_plain_html("regexp_extract(html, '(?s)<article>.*?<h1>(.*?)</h1>', 1)")} AS title, 'utf-8' AS author, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
  {_plain_html(ARTICLE)} AS body_text,
  replace(replace(regexp_replace({ARTICLE}, '<br>(<p>|</article>)', '<br/></b></p>\1', 'g'), '&quot;', '"'), '&#x27;', chr(39)) AS body_html FROM pages""")
def _(t):
    a = articles.extract_articles(t.pages, TEMPLATE)
    return a.select("page_id", "url", F.coalesce("title", F.lit("")).alias("title"), "author", F.col("published_at_raw").alias("lang"), F.coalesce("body_text", F.lit("")).alias("body_text"),
                    F.coalesce("body_html", F.lit("")).alias("body_html"))


@query("extract_articles_fallback", rf"""
WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<title>.*?</title>', '', 'g'), '(?s)<(nav|footer|article)>.*?</(nav|footer|article)>', '', 'g') AS rest FROM pages),
s AS (SELECT page_id, {_plain_html("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, {_plain_html(ARTICLE)} AS article,
  {_plain_html("regexp_replace(html, '(?s)^.*?<body>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'g')")} AS whole,
  list_sum(list_transform(string_split_regex({ARTICLE}, '<h1>|<p>'), lambda x: length({_plain_html('x')}))) AS article_score,
  length({_plain_html("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")}) + length({_plain_html("regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)")})
    - 2 * coalesce(list_sum(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a[^>]*>.*?</a>'), lambda x: length({_plain_html('x')}))), 0) AS body_score FROM p)
SELECT page_id, title, CASE WHEN article_score > greatest(body_score, 0) THEN article WHEN body_score > 0 THEN whole ELSE '' END AS body_text FROM s""")
def _(t):
    """Without a body selector the densest block is taken."""
    return articles.extract_articles(t.pages, {"detail": {}}).select("page_id", "title", F.coalesce("body_text", F.lit("")).alias("body_text"))


@query("crawl_lists", """
SELECT 'src' || (page_id % 20) AS source_id, page_id // 20 % 3 AS page_no, 'https://site' || (page_id % 20) || '.example/a/' || page_id AS url
FROM pages WHERE page_id // 20 % 3 < CASE WHEN page_id % 20 % 2 = 0 THEN 9 ELSE 2 END""")
def _(t):
    """pages as links on three list pages per source: the last one leads back to the first, the second repeats a link with a tracking parameter."""
    source, part = F.col("page_id") % 20, (F.floor(F.col("page_id") / 20) % 3).cast("int")
    line = F.concat(F.lit('<li><a href="/a/'), F.col("page_id").cast("string"), F.lit('">x</a></li>'))
    lists = t.pages.groupBy(source.alias("s"), part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("page_id", line.alias("line")))).alias("l"))
    site = F.concat(F.lit("https://site"), F.col("s").cast("string"), F.lit(".example"))
    again = F.when(F.col("part") == 1, F.concat(F.lit('<li><a href="/a/'), F.col("s").cast("string"), F.lit('?utm_source=x#top">x</a></li>'))).otherwise("")
    body = F.concat(F.lit('<html><nav><a href="/about">x</a></nav><ul class="items">'), F.array_join("l.line", ""), again,
                    F.lit('</ul><a class="next" href="list?page='), ((F.col("part") + 1) % 3).cast("string"), F.lit('">next</a><a class="next" href="/other">y</a>'))
    pages = lists.select(F.concat(site, F.lit("/list?page="), F.col("part").cast("string")).alias("url"), body.alias("html"))
    one = lists.where("part = 0").select(
        F.concat(F.lit("src"), F.col("s").cast("string")).alias("source_id"), F.concat(site, F.lit("/list?page=0")).alias("base_url"), F.lit("ul.items a").alias("item_links_css"),
        F.lit("a.next").alias("next_page_css"), F.when(F.col("s") % 2 == 0, F.lit(9)).otherwise(2).alias("max_pages"))
    return articles.crawl_lists(one, pages).select("source_id", "page_no", "url")


@query("selected_links", r"""
SELECT page_id, replace(unnest(h), '&amp;', '&') AS href, generate_subscripts(h, 1) - 1 AS position FROM (
  SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?is)<a\s+href="([^"]+)"', 1) AS h FROM pages)""")
def _(t):
    return articles.selected_links(t.pages, "nav a").select("page_id", "href", "position")


def bot_payloads(t) -> DataFrame:
    """messages as bot answers: plain arrays for one third of them, objects with one of two list names for the rest."""
    m = messages(t)
    k = F.col("message_id")
    message = F.to_json(F.struct(
        F.when(k % 3 == 0, k.cast("string")).alias("message_id"), F.when(k % 3 == 1, k).alias("messageId"), F.when(k % 3 == 2, k).alias("id"),
        F.when(k % 2 == 0, F.col("text")).otherwise(F.lit(" ")).alias("text"), F.when(k % 2 == 1, F.struct("text")).alias("body"),
        F.when(k % 5 == 0, F.concat(F.lit("https://x.example/"), k.cast("string"))).alias("url"),
        F.when(k % 4 != 0, F.unix_millis("published_at")).alias("timestamp"), F.when(k % 4 == 0, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at")))
    body = F.when(k % 3 == 0, F.concat(F.lit("["), message, F.lit("]"))).when(k % 3 == 1, F.concat(F.lit('{"messages":['), message, F.lit("]}"))).otherwise(
        F.concat(F.lit('{"data":['), message, F.lit("]}")))
    return m.select(F.col("channel").alias("source_id"), F.col("channel").alias("channel_id"), body.alias("body"), F.col("published_at").alias("fetched_at"))


@query("bot_messages", f"""
WITH {MESSAGES} SELECT channel AS channel_id, CAST(message_id AS VARCHAR) AS message_id, CASE WHEN message_id % 5 = 0 THEN 'https://x.example/' || message_id ELSE 'max://' || channel || '/' || message_id END AS url,
  {NORM} AS content_text, {ts_sql('published_at')} AS published_at FROM messages WHERE {NORM} <> ''""")
def _(t):
    b = posts.bot_messages(bot_payloads(t))
    return b.select("channel_id", "message_id", "url", "content_text", ts_text(F.col("published_at")).alias("published_at"))


def wall_payloads(t) -> DataFrame:
    m = messages(t)
    k = F.col("message_id")
    post = F.to_json(F.struct(k.alias("id"), (-k % 7).alias("owner_id"), F.when(k % 2 == 0, F.col("text")).otherwise(F.lit("")).alias("text"),
                              F.when(k % 3 != 0, F.unix_seconds("published_at")).otherwise(F.lit(0)).alias("date"),
                              F.when(k % 2 == 1, F.array(F.struct("text"))).alias("copy_history")))
    body = F.when(k % 11 == 5, F.lit('{"error":{"error_code":5,"error_msg":"denied"}}')).otherwise(F.concat(F.lit('{"response":{"count":1,"items":['), post, F.lit("]}}")))
    return m.select(F.col("channel").alias("source_id"), body.alias("body"), F.col("published_at").alias("fetched_at"))


@query("wall_posts", f"""
WITH {MESSAGES} SELECT message_id, 'https://vk.com/wall' || (-message_id % 7) || '_' || message_id AS url, {NORM} AS content_text, {ts_sql('CASE WHEN message_id % 3 <> 0 THEN published_at END')} AS published_at
FROM messages WHERE message_id > 0 AND message_id % 11 <> 5 AND {NORM} <> ''""")
def _(t):
    return posts.wall_posts(wall_payloads(t)).select("message_id", "url", "content_text", ts_text(F.col("published_at")).alias("published_at"))


@query("wall_errors", "SELECT role AS source_id, count(*) AS errors FROM conversations WHERE (conv_id * 1000 + turn) % 11 = 5 GROUP BY 1")
def _(t):
    return posts.wall_errors(wall_payloads(t)).groupBy("source_id").agg(F.count(F.lit(1)).alias("errors"))


@query("channel_messages", f"""
WITH {MESSAGES} SELECT message_id, channel AS author, 'https://t.me/' || channel || '/' || message_id AS url, substr({NORM}, 1, 120) AS title FROM messages WHERE {NORM} <> ''""")
def _(t):
    return posts.channel_messages(messages(t), F.concat(F.lit("@"), F.col("channel"))).select("message_id", "author", "url", "title")


@query("quote_rows", """
SELECT o_orderkey AS source_id, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice + 1 ELSE NULL END AS value,
  CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate + INTERVAL 7 HOUR, '%Y-%m-%d %H') END AS updated, CASE o_orderkey % 4 WHEN 2 THEN 'no LAST or WAPRICE' WHEN 3 THEN 'marketdata is empty' END AS error
FROM (SELECT * FROM orders) WHERE true""")
def _(t):
    k = F.col("o_orderkey")
    price, more = F.col("o_totalprice").cast("string"), (F.col("o_totalprice") + 1).cast("string")
    row = (F.when(k % 4 == 0, F.concat(F.lit('["A",'), price, F.lit(","), more, F.lit(',"10:30:00"]')))
           .when(k % 4 == 1, F.concat(F.lit('["A",null,'), more, F.lit(',""]'))).when(k % 4 == 2, F.lit('["A",null,null,null]')))
    body = F.concat(F.lit('{"marketdata":{"columns":["SECID","LAST","WAPRICE","UPDATETIME"],"data":['), F.coalesce(row, F.lit("")), F.lit("]}}"))
    # noon UTC of the order day is the same day in Moscow
    p = t.orders.select(k.alias("source_id"), body.alias("body"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 12 hours")).alias("fetched_at"))
    q = quotes.quote_rows(p)
    hour = F.date_format(F.from_utc_timestamp("updated_at", quotes.MOSCOW) - F.expr("interval 3 hours"), "yyyy-MM-dd HH")
    return q.select("source_id", F.col("period_date").cast("string").alias("day"), "value", hour.alias("updated"), "error")


# --- whole intake, batch and stream ------------------------------------------------------------------

GLOBAL = {"global_exclude_keywords": ["cionado"]}


def page_entries(pages: DataFrame) -> DataFrame:
    """Pages as entries of sources, with the visible text as content."""
    return pages.select(
        F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("source_id"), "url",
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), html.html_to_text(F.col("html")).alias("content_text"),
        F.timestamp_seconds(F.lit(ITEM_START) + F.col("page_id") * 3600).alias("published_at"),
        F.timestamp_seconds(F.lit(ITEM_START) + F.col("page_id")).alias("fetched_at"))


def _enriched(t, entries: DataFrame) -> DataFrame:
    now = F.timestamp_seconds(F.lit(ITEM_START))
    return enrich_items(entries, sources(t), GLOBAL, competitors(t), developers(t), regions(t), now)


@query("enrich_items")
def _(t):
    """Whole intake of the pages as a batch."""
    e = _enriched(t, page_entries(t.pages))
    return e.select("source_id", "canonical_url", "title", "normalized_text_hash", "simhash64", joined(F.col("competitor_mentions")).alias("competitors"),
                    joined(F.col("region_ids")).alias("regions"), F.col("period_month").cast("string").alias("month"))


@query("feed_errors", f"""
SELECT 'src' || part AS source_id, 'mismatched tag' AS reason, 1 AS broken_items FROM (SELECT DISTINCT doc_id // {PER_FEED} AS part FROM documents) WHERE part % 2 = 0""")
def _(t):
    return feeds.feed_errors(feed_payloads(t)).select("source_id", "reason", "broken_items")


@query("feed_entries", f"""
WITH {ITEMS} SELECT url, {NORM.replace('text', CLEAN.format('content_text'))} AS content_text, item_id % 2 = 0 AND item_id // {PER_FEED} % 2 = 0 AS short_summary,
  {ts_sql("TIMESTAMP '2024-01-01' + to_seconds(item_id // " + str(PER_FEED) + ")")} AS fetched_at FROM items""")
def _(t):
    """Feed items in the entry schema of all connectors."""
    e = entries.entries(feeds.rss_items(feed_payloads(t)))
    short = (F.col("summary") == "short") & F.col("source_id").rlike("[02468]$")
    return e.select("url", F.coalesce("content_text", F.lit("")).alias("content_text"), F.coalesce(short, F.lit(False)).alias("short_summary"),
                    ts_text(F.col("fetched_at")).alias("fetched_at"))


def _stream(t, name: str) -> DataFrame:
    """The same parquet table, a file or a folder of files, as a file stream."""
    schema = getattr(t, name).schema
    # as a pattern the path may be either; a plain one would have to be a folder
    return t.spark.readStream.schema(schema).parquet(f"{t.root}/[{name[0]}]{name[1:]}.parquet")


@query("stream_ingest")
def _(t):
    """Pages as a stream through the whole intake; equals the batch intake with the first row per canonical url."""
    target = new_path(t.spark, "ingest")
    jobs.stream_ingest(_stream(t, "pages"), target, lambda b: _enriched(t, page_entries(b))).awaitTermination()
    return t.spark.read.parquet(f"{target}/items").select("canonical_url", "source_id", "simhash64", joined(F.col("competitor_mentions")).alias("competitors"))


@query("stream_dedup", f"""
SELECT DISTINCT {CANON_SQL} AS canonical_url FROM (SELECT u, {CANON_KEPT} AS kept FROM (SELECT trim(url) AS u FROM pages))""")
def _(t):
    target = new_path(t.spark, "dedup")
    rows = _stream(t, "pages").select(canonicalize_url(F.col("url")).alias("canonical_url"),
                                      F.timestamp_seconds(F.lit(ITEM_START) + F.col("page_id")).alias("seen_at"))
    jobs.stream_dedup(rows, target, ["canonical_url"], "seen_at").awaitTermination()
    return t.spark.read.parquet(f"{target}/rows").select("canonical_url")


@query("stream_cursor", f"WITH {MESSAGES} SELECT channel, CAST(max(message_id) AS VARCHAR) AS cursor FROM messages GROUP BY 1")
def _(t):
    target = new_path(t.spark, "cursor")
    s = _stream(t, "conversations").select(F.col("role").alias("channel"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("message_id"))
    jobs.stream_cursor(s, target, "channel", "message_id").awaitTermination()
    return jobs.read_state(t.spark, target).select("channel", "cursor")


@query("stream_health", f"""
WITH {HEALTH_SQL} SELECT source_id, {ts_sql('last_fetch_at')} AS last_fetch_at, consecutive_failures, {ts_sql('backoff_until')} AS backoff_until FROM health""")
def _(t):
    from .registry import Tables

    class Streamed(Tables):
        @property
        def events(self):
            return _stream(t, "events")

    target = new_path(t.spark, "health")
    jobs.stream_health(run_log(Streamed(t.spark, t.root)), target).awaitTermination()
    return jobs.read_state(t.spark, target).select("source_id", ts_text(F.col("last_fetch_at")).alias("last_fetch_at"), "consecutive_failures",
                                                   ts_text(F.col("backoff_until")).alias("backoff_until"))


def _batches(t, df: DataFrame, order: str, files: int = 4) -> DataFrame:
    """A table as a file stream of several micro-batches: range ``order`` cut into ``files`` folders, read one file at a time."""
    path = new_path(t.spark, "batches")
    low, high = df.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((F.col(order) - F.lit(low)) * files / F.lit((high or 0) - (low or 0) + 1)), F.lit(files - 1))
    for i in range(files):
        df.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_rate", f"""
WITH m AS (SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY ALL)
SELECT event_type, {ts_sql('minute')} AS minute, requests FROM m WHERE minute + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM events)""")
def _(t):
    """Rates in append mode: a minute is written once the watermark has passed it, and its state is dropped."""
    rows = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    s = _batches(t, rows, "at")
    out = jobs.run_to_table(jobs.stream_rate(s, "event_type"), new_path(t.spark, "rate"), "append")
    return out.select("event_type", ts_text(F.col("minute")).alias("minute"), "requests")


LATE_STEP = 997


@query("late_policy", f"""
WITH s AS (SELECT event_id, event_type, ts, least(floor((event_id - (SELECT min(event_id) FROM events)) * 4 / (SELECT max(event_id) - min(event_id) + 1 FROM events)), 3) AS part FROM
  (SELECT event_id, event_type, CASE WHEN event_id % {LATE_STEP} < 100 THEN ts - to_hours(CAST(event_id % {LATE_STEP} AS INTEGER)) ELSE ts END AS ts FROM events)),
n AS (SELECT part, max(ts) AS newest FROM s GROUP BY 1)
SELECT event_type, count(*) AS n FROM s WHERE ts >= coalesce((SELECT max(newest) FROM n WHERE n.part < s.part), ts) - INTERVAL 48 HOUR GROUP BY 1""")
def _(t):
    """Events in four micro-batches, some of them up to 99 hours late; 48 hours are allowed."""
    target, step = new_path(t.spark, "late"), F.col("event_id") % LATE_STEP
    ts = F.col("ts").cast("timestamp")
    rows = t.events.select("event_id", "event_type", F.when(step < 100, F.timestamp_micros(F.unix_micros(ts) - step * F.lit(3_600_000_000))).otherwise(ts).alias("ts"))
    jobs.late_policy(_batches(t, rows, "event_id"), target, "ts").awaitTermination()
    return jobs.appended_rows(t.spark, target, rows.schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("backfill", f"""
WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS i FROM events), p AS (SELECT *, i // 10 AS page FROM r),
e AS (SELECT user_id, page, bool_or(ts < TIMESTAMP '2024-01-20') AS old, count(*) AS n FROM p GROUP BY ALL), l AS (SELECT user_id, coalesce(min(page) FILTER (WHERE old OR n < 10), max(page)) AS last FROM e GROUP BY 1)
SELECT p.user_id AS channel, max(page) FILTER (WHERE page <= last) + 1 AS pages, coalesce(bool_or(ts < TIMESTAMP '2024-01-20'), false) AS reached_until,
  count_if(page <= last AND coalesce(ts >= TIMESTAMP '2024-01-20', true)) AS kept, count_if(coalesce(ts >= TIMESTAMP '2024-01-20', true)) AS wanted,
  max(event_id) AS last_message_id, min(event_id) AS first_message_id, {ts_sql('min(ts)')} AS oldest_at FROM p JOIN l ON p.user_id IS NOT DISTINCT FROM l.user_id GROUP BY 1""")
def _(t):
    """Every history paged backwards, and what the whole of it holds."""
    m = t.events.select(F.col("user_id").alias("channel"), F.col("event_id").alias("message_id"), F.col("ts").cast("timestamp").alias("published_at"))
    kept, status = jobs.backfill(m, dt.date(2024, 1, 20), page_size=10)
    n = kept.groupBy(F.struct("channel").alias("c")).agg(F.count_if("in_pages").alias("kept"), F.count(F.lit(1)).alias("wanted"))
    found = status.drop("kept", "wanted").withColumn("c", F.struct("channel")).join(n, "c", "left").drop("c")
    return found.withColumns({"kept": F.coalesce("kept", F.lit(0)), "wanted": F.coalesce("wanted", F.lit(0)), "oldest_at": ts_text(F.col("oldest_at"))})


@query("stream_ingest_repeated", f"""
SELECT canonical_url, first_id FROM (SELECT canonical_url, min(page_id) AS first_id FROM
  (SELECT page_id, {CANON_SQL} AS canonical_url FROM (SELECT page_id, u, {CANON_KEPT} AS kept FROM (SELECT page_id, trim(url) AS u FROM pages))) GROUP BY 1)""")
def _(t):
    """Pages in four micro-batches through the ingest, and all of them once more by another stream: known urls stay as they were first seen."""
    target = new_path(t.spark, "repeated")
    rows = t.pages.select("page_id", "url", F.timestamp_seconds(F.lit(ITEM_START) + F.col("page_id")).alias("fetched_at"))

    def prepare(batch: DataFrame) -> DataFrame:
        return batch.withColumns({"canonical_url": canonicalize_url(F.col("url")), "first_id": F.col("page_id"), "period_month": F.trunc("fetched_at", "month")})

    for _run in range(2):
        jobs.stream_ingest(_batches(t, rows, "page_id"), target, prepare).awaitTermination()
        target_items = t.spark.read.parquet(f"{target}/items")
        discard(t.spark, f"{target}/_checkpoint")  # a new stream: it doesn't know what the first one has read
    return target_items.select("canonical_url", "first_id")


@query("ingest_runs", """
WITH b AS (SELECT count(*) AS n FROM pages) SELECT CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(matched) AS BIGINT) AS matched FROM (SELECT n AS fetched, (SELECT count(*) FROM pages WHERE page_id % 10 <> 0) AS matched FROM b)""")
def _(t):
    """Run statistics of an ingest in four micro-batches, observed while it writes: every matched row was inserted or skipped."""
    target = new_path(t.spark, "runs")
    rows = t.pages.select("page_id", "url", F.timestamp_seconds(F.lit(ITEM_START) + F.col("page_id")).alias("fetched_at"))
    jobs.stream_ingest(_batches(t, rows, "page_id"), target, lambda b: b.where("page_id % 10 <> 0").withColumn("canonical_url", canonicalize_url(F.col("url"))),
                       partition_by=[]).awaitTermination()
    log = jobs.run_log(t.spark, target)
    return log.where("matched = inserted + skipped").agg(F.sum("fetched").alias("fetched"), F.sum("matched").alias("matched"))


@query("rebuild_clusters", f"""
WITH RECURSIVE {MEMBERS_SQL} SELECT primary_id, 0 AS part_no, string_agg(item_id, '|' ORDER BY published_at, item_id) AS related FROM members WHERE item_id <> primary_id GROUP BY 1""")
def _(t):
    """Scheduled rebuild: the cluster table is written anew and read back."""
    from ..operators import clusters
    from ..session import stage
    return stage(clusters.build_clusters(clusters.with_simhash(items(t))), "clusters").select(
        "primary_id", "part_no", joined(F.col("related_item_ids")).alias("related"))
