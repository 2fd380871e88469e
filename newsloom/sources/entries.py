"""One entry schema for all connectors: what ``ingest.enrich_items`` takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, strip

ENTRY = {"source_id": "string", "url": "string", "title": "string", "summary": "string", "content_text": "string",
         "published_at": "timestamp", "fetched_at": "timestamp"}


def entries(rows: DataFrame, **renamed: str | Column) -> DataFrame:
    """Rows of a connector as entries (source_id, url, title, summary, content_text, published_at, fetched_at).

    Columns keep their names unless ``renamed`` says otherwise, e.g. ``entries(articles, content_text="body_text")``; what a connector
    lacks is null. Rows without a url are left out. Works on the output of ``rss_items``, ``bot_messages``, ``wall_posts``,
    ``channel_messages`` and ``extract_articles``.
    """
    def value(name: str, kind: str) -> Column:
        given = renamed.get(name, name if name in rows.columns else None)
        column = F.lit(None) if given is None else F.col(given) if isinstance(given, str) else given
        return column.cast(kind).alias(name)

    out = rows.select(*[value(n, k) for n, k in ENTRY.items()])
    return out.where(F.coalesce(strip(F.col("url")), F.lit("")) != "")


def region_text() -> Column:
    """Content of an entry, else its summary: the text its regions are looked for in."""
    return F.coalesce(F.nullif(F.col("content_text"), F.lit("")), normalize_text(F.col("summary")))
