"""HTML columns: tags out, entities decoded, anchors found. Native expressions only."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..functions.urls import absolute_url, canonicalize_url
from ..scale import keep_first

HIDDEN = r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>"
TAG = r"(?s)<[/!?]?[A-Za-z][^>]*>|<[!?][^>]*>"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?"
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _code_point(hex_digits: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")


def _decode_entity(e: Column) -> Column:
    names = F.create_map(*[x for name, cp in sorted(name2codepoint.items()) for x in (F.lit(name), F.lit(chr(cp)))],
                         F.lit("apos"), F.lit("'"))
    body = F.regexp_replace(e, "^&|;$", "")
    return F.coalesce(
        F.when(body.rlike("^#[xX]"), _code_point(F.substring(body, 3, 8)))
        .when(body.rlike("^#"), _code_point(F.hex(F.substring(body, 2, 8).try_cast("bigint"))))
        .otherwise(F.try_element_at(names, body)), e)


def unescape(c: Column) -> Column:
    """Decode numeric and HTML 4 named character references in one pass; unknown ones stay."""
    def decode(t: Column) -> Column:
        pieces = F.split(t, ENTITY, -1)
        found = F.transform(F.regexp_extract_all(t, F.lit(f"({ENTITY})"), F.lit(1)), _decode_entity)
        return F.array_join(F.flatten(F.zip_with(pieces, found, lambda p, e: F.array(p, F.coalesce(e, F.lit(""))))), "")

    return F.when(F.contains(c, F.lit("&")), F.transform(F.array(c), decode)[0]).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Visible text: scripts, styles, comments and tags out, entities decoded, whitespace collapsed."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), HIDDEN, " "), TAG, " ")
    return normalize_text(unescape(bare))


def anchors(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """(page_id, page_url, position, href, url): every anchor with its absolute url."""
    raw = F.regexp_extract_all(F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " "),
                               F.lit(ANCHOR), F.lit(1))
    rows = pages.select(page_id, F.col(url).alias("page_url"), F.posexplode(raw).alias("position", "_raw"))
    href = unescape(F.regexp_replace(F.col("_raw"), "^[\"']|[\"']$", ""))
    return rows.withColumn("href", href).where("href <> ''").withColumn(
        "url", absolute_url(F.col("page_url"), F.col("href"))).drop("_raw")


def first_links(links: DataFrame, listing: str, order: list[str]) -> DataFrame:
    """First link per listing and canonical url."""
    keyed = links.withColumn("canonical_url", canonicalize_url(F.col("url")))
    return keep_first(keyed, [listing, "canonical_url"], order)


def discover_links(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Distinct links of each page, as listing pages without a template see them (every anchor)."""
    return first_links(anchors(pages, page_id, url, html), page_id, ["position"])
