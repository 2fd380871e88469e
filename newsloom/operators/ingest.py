"""From parsed entries to stored items: canonical url, fingerprints, keyword rule, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import period_month
from ..functions.fingerprint import simhash64
from ..functions.text import normalize_text, text_sha256
from ..functions.urls import canonicalize_url
from ..scale import attach
from ..sources.entries import region_text
from .filters import effective_rule, explain_keywords, merge_filter_cfg, search_text
from .tagging import resolve_regions, tag_entities


def enrich_items(entries: DataFrame, sources: DataFrame, global_cfg: dict, competitors: DataFrame,
                 developers: DataFrame, regions: DataFrame, now: Column) -> DataFrame:
    """Item rows ready to insert, from entries (source_id, url, title, content_text, published_at; ``sources.entries``).

    Entries that fail their source's keyword rule are dropped; those of unknown sources are judged by the global words. One
    projection after one lookup join. A summary, where entries have one, counts for the rules and tags, and stands in for an
    empty content when regions are looked for.
    """
    rules = merge_filter_cfg(sources, global_cfg).select(
        "source_id", "include", "exclude", "whole_words", "competitor_id", "developer_id",
        F.col("region_tags").alias("source_region_ids"))
    text = normalize_text(F.col("content_text"))
    rows = attach(entries, rules, ["source_id"])
    told = ["summary"] if "summary" in entries.columns else []
    rows = rows.withColumn("_hay", search_text("url", "title", "content_text", *told))
    rows = rows.where(explain_keywords(F.col("_hay"), *effective_rule(global_cfg))["keep"])
    rows = rows.withColumns({
        "canonical_url": canonicalize_url(F.col("url")),
        "period_month": period_month(F.col("published_at"), now),
        "snippet": F.nullif(F.substring(text, 1, 300), F.lit("")),
        "normalized_text_hash": text_sha256(F.col("content_text")),
        "simhash64": simhash64(F.col("content_text"))})
    for kind, dim in (("competitor", competitors), ("developer", developers)):
        rows = tag_entities(rows, dim, F.col("_hay"), f"{kind}_mentions")
    if told:
        rows = rows.withColumns({"_content": F.col("content_text"), "content_text": region_text()})
    rows = resolve_regions(rows, regions)
    if told:
        rows = rows.withColumn("content_text", F.col("_content")).drop("_content")
    return rows.drop("_hay", "include", "exclude", "whole_words", "source_region_ids")
