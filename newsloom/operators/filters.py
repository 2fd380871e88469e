"""Row filters over items, posts and sources. All of them are plain predicates that reach the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import keyword_hits, ordered_union, parse_keyword_list
from ..functions.text import let, strip
from ..scale import attach


def at(ts: dt.datetime) -> Column:
    """A fixed clock reading (naive values are UTC) as an absolute instant."""
    aware = ts if ts.tzinfo else ts.replace(tzinfo=dt.timezone.utc)
    micros = (aware - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def minutes(n: Column) -> Column:
    return F.make_dt_interval(mins=n)


# --- keyword rules -----------------------------------------------------------------------------------

def explain_keywords(text: Column, include: Column, exclude: Column, whole_words: Column) -> Column:
    """struct<keep, reason, matched_keywords>; an exclude hit wins, then a missing include."""
    none = F.expr("cast(array() as array<string>)")

    def verdict(keep: bool, reason: str, words: Column) -> Column:
        return F.struct(F.lit(keep).alias("keep"), F.lit(reason).alias("reason"), words.alias("matched_keywords"))

    def judge(hits: Column) -> Column:
        return (F.when(F.size(hits["bad"]) > 0, verdict(False, "exclude", hits["bad"]))
                .when(F.size(include) == 0, verdict(True, "no_filter", none))
                .when(F.size(hits["good"]) > 0, verdict(True, "include", hits["good"]))
                .otherwise(verdict(False, "include_missing", none)))

    def look(hay: Column) -> Column:
        return let(F.struct(keyword_hits(hay, exclude, whole_words).alias("bad"),
                            keyword_hits(hay, include, whole_words).alias("good")), judge)

    return let(strip(F.lower(F.coalesce(text, F.lit("")))), look)


def literal_words(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def keep_by_keywords(df: DataFrame, text: Column, include: Sequence[str], exclude: Sequence[str],
                     whole_words: bool = False) -> DataFrame:
    """Rows that pass one keyword rule."""
    rule = [parse_keyword_list(literal_words(w)) for w in (include, exclude)]
    return df.where(explain_keywords(text, *rule, F.lit(whole_words))["keep"])


def merge_filter_cfg(sources: DataFrame, global_cfg: dict) -> DataFrame:
    """Add the effective include, exclude and whole_words of each source: its own words, then the global ones."""
    def words(own: str, shared: str) -> Column:
        return ordered_union(parse_keyword_list(F.col(own)), parse_keyword_list(literal_words(global_cfg.get(shared, []))))

    return sources.withColumns({
        "include": words("include_keywords", "global_include_keywords"),
        "exclude": words("exclude_keywords", "global_exclude_keywords"),
        "whole_words": F.coalesce("match_whole_words", F.lit(False)) | F.lit(bool(global_cfg.get("match_whole_words"))),
    })


def search_text(*parts: str) -> Column:
    return F.array_join(F.array(*[F.coalesce(F.col(p), F.lit("")) for p in parts]), " ")


def judged_items(items: DataFrame, sources: DataFrame, global_cfg: dict) -> DataFrame:
    """Stored items with the verdict of their source's effective rule in ``verdict``."""
    rules = merge_filter_cfg(sources, global_cfg).select("source_id", "include", "exclude", "whole_words")
    joined = attach(items, rules, ["source_id"])
    hay = search_text("url", "title", "snippet", "content_text")
    return joined.withColumn("verdict", explain_keywords(hay, *effective_rule(global_cfg))).drop("include", "exclude", "whole_words")


def effective_rule(global_cfg: dict) -> list[Column]:
    """(include, exclude, whole_words) after a left join with ``merge_filter_cfg``: the global words where the source is unknown."""
    none = F.expr("cast(array() as array<string>)")
    shared = [parse_keyword_list(literal_words(global_cfg.get(k, [])))
              for k in ("global_include_keywords", "global_exclude_keywords")]
    words = [F.when(F.col("whole_words").isNull(), s).otherwise(F.coalesce(c, none))
             for c, s in zip(("include", "exclude"), shared)]
    return [*words, F.coalesce("whole_words", F.lit(bool(global_cfg.get("match_whole_words"))))]


def filter_cleanup(items: DataFrame, sources: DataFrame, global_cfg: dict) -> tuple[DataFrame, DataFrame]:
    """(kept items, one row deleted / total_checked). Whether the kept items replace the table is up to the caller."""
    judged = judged_items(items, sources, global_cfg)
    stats = judged.agg(F.count_if(~F.col("verdict.keep")).alias("deleted"), F.count(F.lit(1)).alias("total_checked"))
    return judged.where("verdict.keep").drop("verdict"), stats


# --- items and posts ---------------------------------------------------------------------------------

def search_news(items: DataFrame, q: str | None = None, source_id=None, competitor_id=None, developer_id=None) -> DataFrame:
    """AND of the given filters; an entity matches as primary or as mention; ``q`` may hold % and _."""
    out = items
    if source_id is not None:
        out = out.where(F.col("source_id") == source_id)
    for kind, wanted in (("competitor", competitor_id), ("developer", developer_id)):
        if wanted is not None:
            out = out.where((F.col(f"{kind}_id") == wanted) | F.array_contains(f"{kind}_mentions", F.lit(wanted)))
    if q:
        like = F.lit(f"%{q}%")
        out = out.where(F.ilike(F.col("title"), like) | F.ilike(F.col("snippet"), like) | F.ilike(F.col("content_text"), like))
    return out


def _day_bounds(date_from: dt.date, date_to: dt.date) -> tuple[Column, Column]:
    low = at(dt.datetime.combine(date_from, dt.time.min))
    high = at(dt.datetime.combine(date_to, dt.time.max))
    return low, high


def in_period(items: DataFrame, date_from: dt.date, date_to: dt.date, month: dt.date | None = None) -> DataFrame:
    """Items of a month (by the partition column) or of an inclusive day range."""
    if month is not None:
        return items.where(F.col("period_month") == F.lit(month))
    low, high = _day_bounds(date_from, date_to)
    return items.where((F.col("published_at") >= low) & (F.col("published_at") <= high))


def posts_in_period(posts: DataFrame, date_from: dt.date, date_to: dt.date) -> DataFrame:
    """Posts of an inclusive day range; undated posts count by their creation time."""
    low, high = _day_bounds(date_from, date_to)
    published, created = F.col("published_at"), F.col("created_at")
    # two plain ranges, so that file statistics of either column can skip row groups
    return posts.where(((published >= low) & (published <= high)) | (published.isNull() & (created >= low) & (created <= high)))


def since_cursor(entries: DataFrame, cursor: dt.datetime | None, overlap_hours: int = 48) -> DataFrame:
    """Entries changed after the cursor minus the overlap; entries without a date always stay."""
    if cursor is None:
        return entries
    cutoff = at(cursor - dt.timedelta(hours=overlap_hours))
    return entries.where(F.col("lastmod").isNull() | (F.col("lastmod") > cutoff))


def newer_than(rows: DataFrame, cursors: DataFrame, key: str, row_id: str) -> DataFrame:
    """Rows above their key's ``last_id``; keys without a cursor pass whole."""
    joined = attach(rows, cursors.select(key, "last_id"), [key])
    return joined.where(F.col("last_id").isNull() | (F.col(row_id) > F.col("last_id"))).drop("last_id")


def not_before(posts: DataFrame, until: dt.date, channel: str) -> tuple[DataFrame, DataFrame]:
    """(posts not older than ``until``, per channel whether older ones were seen)."""
    old = F.coalesce(F.to_date("published_at") < F.lit(until), F.lit(False))
    reached = posts.groupBy(channel).agg(F.max(old).alias("reached_until"))
    return posts.where(~old), reached


# --- sources and dimensions --------------------------------------------------------------------------

def due_sources(sources: DataFrame, now: dt.datetime) -> DataFrame:
    """Enabled sources out of backoff whose fetch interval has passed."""
    clock = at(now)
    free = F.col("backoff_until").isNull() | (F.col("backoff_until") <= clock)
    waited = F.col("last_fetch_at").isNull() | (F.col("last_fetch_at") <= clock - minutes(F.col("fetch_frequency_min")))
    return sources.where(F.col("enabled") & free & waited)


def filter_sources(sources: DataFrame, source_type=None, competitor_id=None, developer_id=None, enabled=None,
                   only_failed: bool = False) -> DataFrame:
    out = sources
    for name, wanted in (("source_type", source_type), ("competitor_id", competitor_id),
                         ("developer_id", developer_id), ("enabled", enabled)):
        if wanted is not None:
            out = out.where(F.col(name) == F.lit(wanted))
    if only_failed:
        out = out.where((F.col("consecutive_failures") > 0) | F.col("last_error").isNotNull())
    return out


def search_dim(dim: DataFrame, q: str | None, name: str = "name") -> DataFrame:
    return dim.where(F.ilike(F.col(name), F.lit(f"%{q}%"))) if q else dim
