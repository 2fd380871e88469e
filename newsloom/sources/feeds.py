"""RSS, Atom and sitemap payloads to rows, from a table of fetched bodies (source_id, url, body, fetched_at)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_iso_ts
from ..functions.text import normalize_text, strip
from ..scale import attach, keep_first, ranked, top_n
from ..session import stage
from .feedxml import FeedReader, entry_url, entry_value
from .html import html_to_text

XML = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "attributePrefix": "_", "valueTag": "_VALUE"}

# Zone names of feed dates, in the order of their offsets.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EDT": "-0400", "EST": "-0500",
         "CDT": "-0500", "CST": "-0600", "MDT": "-0600", "MST": "-0700", "PDT": "-0700", "PST": "-0800"}


def feed_date(c: Column) -> Column:
    """RFC 822 or ISO date of a feed."""
    s = F.regexp_replace(strip(c), r"^[A-Za-z]{3,9},?\s+", "")
    s = F.regexp_replace(s, r"^(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4})", "$1 $2 $3")
    s = F.regexp_replace(s, r"^([^:]*\d{1,2}:\d{2})( |$)", "$1:00$2")
    for name, offset in ZONES.items():
        s = F.regexp_replace(s, rf"\s{name}$", f" {offset}")
    return F.coalesce(F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss Z")), parse_iso_ts(strip(c)))


def _first(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols])


def _read(payloads: DataFrame) -> DataFrame:
    """One row per entry of every feed, broken ones with ``broken``, and one row with ``error`` per body that is no sound feed."""
    kinds = dict(payloads.dtypes)
    schema = ", ".join(f"{c} {kinds[k]}" for c, k in (("source_id", "source_id"), ("feed_url", "url"), ("fetched_at", "fetched_at")))
    texts = ("url", "title", "summary", "content", "published", "updated", "error")

    def run(batches):
        for batch in batches:
            owner, position, broken, out = [], [], [], {t: [] for t in texts}

            def add(row, at, lost, **values):
                owner.append(row)
                position.append(at)
                broken.append(lost)
                for t in texts:
                    out[t].append(values.get(t))

            for row, body in enumerate(batch["body"].to_pylist()):
                feed = FeedReader(body)
                for at, e in enumerate(feed.entries):
                    if e is None:
                        add(row, at, True)
                    else:
                        add(row, at, False, url=entry_url(e), **{f: entry_value(e, f) for f in texts[1:6]})
                if feed.error:
                    add(row, None, False, error=feed.error)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch[c].take(take) for c in ("source_id", "feed_url", "fetched_at")] + [pa.array(position, pa.int32()), pa.array(broken, pa.bool_())]
                + [pa.array(out[t], pa.string()) for t in texts], names=["source_id", "feed_url", "fetched_at", "position", "broken", *texts])

    rows = payloads.select("source_id", F.col("url").alias("feed_url"), "fetched_at", F.col("body").cast("binary").alias("body"))
    return rows.mapInArrow(run, f"{schema}, position int, broken boolean, " + ", ".join(f"{t} string" for t in texts))


def feed_errors(payloads: DataFrame) -> DataFrame:
    """Payloads that are no sound feed: (source_id, url, fetched_at, reason, broken_items). Entries that could be read are in ``rss_items`` all the same."""
    keys = ["source_id", "feed_url", "fetched_at"]
    lost = _read(payloads).where("broken or error is not null").groupBy(*keys).agg(
        F.max("error").alias("reason"), F.count_if("broken").alias("broken_items"))
    return lost.select("source_id", F.col("feed_url").alias("url"), "fetched_at", F.coalesce("reason", F.lit("entry without an end")).alias("reason"), "broken_items")


def rss_items(payloads: DataFrame) -> DataFrame:
    """One row per feed entry with an address: (source_id, feed_url, position, url, title, summary,
    content_html, content_text, published_at, fetched_at). What could not be read is told by ``feed_errors``."""
    rows = _read(payloads).where("not broken and url is not null")
    html = F.coalesce(F.nullif("content", F.lit("")), F.when(F.contains("summary", F.lit("<")), F.col("summary")))
    rows = rows.select("source_id", "feed_url", "fetched_at", "position", "url", "title", "summary",
                       F.coalesce(feed_date(F.col("published")), feed_date(F.col("updated"))).alias("published_at"), html.alias("content_html"))
    text = F.when(F.col("content_html").isNotNull(), html_to_text(F.col("content_html"))).otherwise(
        F.when(F.coalesce("summary", F.lit("")) != "", normalize_text(F.col("summary"))))
    return rows.withColumn("content_text", text)


URL_ENTRY = "struct<loc:string,lastmod:string>"
SITEMAP = f"url array<{URL_ENTRY}>, sitemap array<struct<loc:string>>, _corrupt_record string"


def _plain_names(body: Column) -> Column:
    """Element names without namespace prefixes."""
    return F.regexp_replace(body, r"(</?)[A-Za-z_][\w.\-]*:", "$1")


def sitemap_kind(body: Column) -> Column:
    """urlset, sitemapindex, other, or malformed."""
    root = F.regexp_extract(_plain_names(body), r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<([\w.\-]+)", 1)
    broken = F.from_xml(_plain_names(body), SITEMAP, XML)["_corrupt_record"].isNotNull()
    return F.when((root == "") | broken, F.lit("malformed")).when(root.isin("urlset", "sitemapindex"), root).otherwise(F.lit("other"))


def sitemap_errors(payloads: DataFrame) -> DataFrame:
    """Payloads that are no well-formed XML: their sources count as failed."""
    return payloads.where(sitemap_kind(F.col("body")) == "malformed").select("source_id", "url", "fetched_at")


def sitemap_urls(payloads: DataFrame, include: str | None = None, exclude: str | None = None,
                 max_urls: int | None = None) -> DataFrame:
    """(source_id, sitemap_url, position, loc, lastmod) of all urlset payloads.

    Payloads may carry ``seq``, the order in which their sitemaps were visited. With ``max_urls`` only the first ones per source are
    returned, each with ``left_out``, the number of urls of its source that were not.
    """
    seq = F.col("seq") if "seq" in payloads.columns else F.lit(0)
    parsed = payloads.where(sitemap_kind(F.col("body")) == "urlset").select(
        "source_id", F.col("url").alias("sitemap_url"), seq.alias("seq"),
        F.from_xml(_plain_names(F.col("body")), SITEMAP, XML).alias("x"))
    rows = parsed.select("source_id", "sitemap_url", "seq", F.posexplode("x.url").alias("position", "u"))
    rows = rows.select("source_id", "sitemap_url", "seq", "position", _first(F.col("u.loc")).alias("loc"),
                       parse_iso_ts(strip(F.col("u.lastmod"))).alias("lastmod")).where("loc is not null")
    if include:
        rows = rows.where(F.col("loc").rlike(include))
    if exclude:
        rows = rows.where(~F.col("loc").rlike(exclude))
    if max_urls is not None:
        count = stage(rows.groupBy("source_id").agg(F.greatest(F.count(F.lit(1)) - max_urls, F.lit(0)).alias("left_out")), "left-out")
        rows = top_n(rows, ["source_id"], [F.col("seq"), F.col("sitemap_url"), F.col("position")], max_urls).drop("rank")
        rows = attach(rows, count, ["source_id"])
    return rows


def sitemap_children(payloads: DataFrame) -> DataFrame:
    """(url, position, child) of all sitemapindex payloads."""
    parsed = payloads.where(sitemap_kind(F.col("body")) == "sitemapindex").select(
        "url", F.from_xml(_plain_names(F.col("body")), SITEMAP, XML).alias("x"))
    rows = parsed.select("url", F.posexplode("x.sitemap").alias("position", "s"))
    return rows.select("url", "position", _first(F.col("s.loc")).alias("child")).where("child is not null")


def expand_sitemap_index(roots: DataFrame, payloads: DataFrame, max_sitemaps: int | None = None) -> DataFrame:
    """(source_id, seq, url) of the sitemaps visited from each root, breadth first, each once.

    Every level is one join of the frontier with the child table, until a level finds nothing new. With ``max_sitemaps`` a source
    visits no more than that.
    """
    children = stage(sitemap_children(payloads), "children")
    frontier = roots.select("source_id", "url", F.lit(0).cast("long").alias("seq"))
    visited = stage(frontier, "visited")
    frontier = visited
    while True:
        found = frontier.join(children, "url").select("source_id", F.col("child").alias("url"), "seq", "position")
        fresh = keep_first(found, ["source_id", "url"], ["seq", "position"]).join(
            visited.select("source_id", "url"), ["source_id", "url"], "left_anti")
        used = visited.groupBy("source_id").agg(F.count(F.lit(1)).alias("used"))
        next_ones = ranked(fresh.withColumn("_seq", F.col("seq")), ["source_id"], ["_seq", "position", "url"])
        next_ones = next_ones.join(used, "source_id")
        if max_sitemaps is not None:
            next_ones = next_ones.where(F.col("rank") + F.col("used") <= max_sitemaps)
        frontier = stage(next_ones.select("source_id", "url", (F.col("rank") + F.col("used") - 1).cast("long").alias("seq")), "frontier")
        if frontier.isEmpty():
            break
        visited = stage(visited.unionByName(frontier), "visited")
    return visited
