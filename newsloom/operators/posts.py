"""Channel posts: albums, report groups, text blocks, latest summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_post_text, strip
from ..scale import attach, keep_first, keep_last, ranked
from .batches import day_text, linked

# Default report groups, text sizes of a post line, and the stem rule.
DEFAULT_GROUPS = [("Ввод жилья", ["ввод жилья", "введено"]), ("Ввод МКД", ["многоквартир", "мкд"])]
DEFAULT_POST = "Пост"
TITLE_CHARS, BODY_CHARS = 200, 900
STEM_CHARS, SHORT_TOKEN, LEAST_ROOT, ENDING = 6, 4, 5, 3


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], where: Column | None = None) -> DataFrame:
    """Newest row per key, optionally among the rows that satisfy ``where``."""
    return keep_last(df.where(where) if where is not None else df, keys, order)


def cursor_max(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, cursor): highest id per key; ids are compared as numbers when all of a key's ids are digits."""
    digits = F.col(value).rlike(r"^\s*[+-]?\d+\s*$")
    number = F.when(digits, F.col(value).try_cast("decimal(38,0)"))
    highest = F.when(F.bool_and(digits), F.max(number).cast("string")).otherwise(F.max(value))
    return df.groupBy(by).agg(highest.alias("cursor"))


def _unit(grouped: Column, message: Column) -> Column:
    return F.when(F.coalesce(grouped, F.lit(0)) != 0, F.concat(F.lit("g"), grouped.cast("string"))).otherwise(
        F.concat(F.lit("m"), message.cast("string")))


def merge_albums(messages: DataFrame) -> DataFrame:
    """One row per album or single message: lowest id, text of the highest id that has any, cleaned.

    Messages have (channel, message_id, grouped_id, text, published_at, image_path). Grouped aggregates only,
    so albums of any size are merged map-side; the images stay in ``album_images``.
    """
    text = strip(F.coalesce("text", F.lit("")))
    units = messages.groupBy("channel", _unit(F.col("grouped_id"), F.col("message_id")).alias("_unit")).agg(
        F.min("message_id").alias("message_id"), F.count(F.lit(1)).alias("messages"),
        F.max_by(text, F.when(text != "", F.col("message_id"))).alias("raw_text"),
        F.min_by("published_at", "message_id").alias("published_at"),
        F.count("image_path").alias("images"))
    return units.select(
        "channel", "message_id", "messages", F.coalesce("raw_text", F.lit("")).alias("raw_text"),
        F.nullif(clean_post_text(F.col("raw_text")), F.lit("")).alias("text"), "published_at", "images",
        F.concat(F.lit("https://t.me/"), F.col("channel"), F.lit("/"), F.col("message_id").cast("string")).alias("post_url"))


def album_images(messages: DataFrame) -> DataFrame:
    """(channel, message_id of the album, image_no, image_path) in id order."""
    unit = messages.withColumn("_unit", _unit(F.col("grouped_id"), F.col("message_id")))
    first = unit.groupBy("channel", "_unit").agg(F.min("message_id").alias("primary_id"))
    rows = ranked(unit.where("image_path is not null").select("channel", "_unit", "message_id", "image_path"),
                  ["channel", "_unit"], ["message_id"], "image_no")
    return rows.drop("message_id").join(first, ["channel", "_unit"]).select(
        "channel", F.col("primary_id").alias("message_id"), "image_no", "image_path")


def merge_tail(new: DataFrame, tail: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union by id in which the re-read tail wins."""
    both = new.withColumn("_tail", F.lit(0)).unionByName(tail.withColumn("_tail", F.lit(1)))
    return keep_last(both, keys, ["_tail"]).drop("_tail")


def union_rows_dedup(a: DataFrame, b: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``a`` then of ``b``, first one per key."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    return keep_first(both, keys, ["_side", *order]).drop("_side")


# --- report groups -----------------------------------------------------------------------------------

def _token_hit(token: str, hay: Column, matched: Column) -> Column:
    """A token occurs in the text, shares a stem with a matched keyword, or occurs without its ending."""
    token = token.strip().lower()
    t = F.lit(token)

    def stem(m: Column) -> Column:
        same = F.contains(t, m) | F.contains(m, t)
        if len(token) >= STEM_CHARS:
            same = same | ((F.char_length(m) >= STEM_CHARS) & F.startswith(m, F.lit(token[:STEM_CHARS])))
        return (m != "") & same

    hit = F.contains(hay, t) | F.exists(matched, stem)
    if len(token) > SHORT_TOKEN:
        hit = hit | F.contains(hay, F.lit(token[:max(LEAST_ROOT, len(token) - ENDING)]))
        if token.startswith("ввод"):
            hit = hit | F.contains(hay, F.lit("введ"))
    return hit


def _keyword_hit(keyword: str, hay: Column, matched: Column) -> Column:
    hit = F.lit(True)
    for part in keyword.split():
        hit = hit & _token_hit(part, hay, matched)
    return hit


def _title_kind(title: str) -> str | None:
    t = title.lower()
    return "mkd" if "мкд" in t or "многоквартир" in t else "housing" if "жиль" in t else None


def assign_post_group(posts: DataFrame, groups: Sequence[tuple[str, Sequence[str]]] | None = None) -> DataFrame:
    """Posts with their report group in ``group_title``; posts of no group are dropped.

    Posts about apartment blocks, then about housing, go to the first group of that kind; others go to the
    first group with a matching keyword. Posts have text and matched_keywords.
    """
    chosen = [(t.strip(), [k.strip().lower() for k in words if k.strip()]) for t, words in (groups or DEFAULT_GROUPS) if t.strip()]

    def pick(x: Column) -> Column:
        hay, matched = x["hay"], x["matched"]
        mkd = _token_hit("многоквартир", hay, matched) | _token_hit("мкд", hay, matched)
        housing = (_token_hit("введено", hay, matched) | _token_hit("жиль", hay, matched)
                   | _keyword_hit("ввод жилья", hay, matched))
        of_kind = {k: next((t for t, _ in chosen if _title_kind(t) == k), None) for k in ("mkd", "housing")}
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        if of_kind["mkd"]:
            out = out.when(mkd, F.lit(of_kind["mkd"]))
        if of_kind["housing"]:
            out = out.when(housing & ~mkd, F.lit(of_kind["housing"]))
        for title, words in chosen:
            hit = F.lit(False)
            for k in words:
                hit = hit | _keyword_hit(k, hay, matched)
            out = out.when(hit, F.lit(title))
        return out

    matched = F.transform(F.coalesce("matched_keywords", F.expr("cast(array() as array<string>)")),
                          lambda m: strip(F.lower(m)))
    text = F.lower(F.coalesce("text", F.lit("")))
    hay = F.when(F.size(matched) > 0, F.concat(text, F.lit(" "), F.array_join(matched, " "))).otherwise(text)
    views = F.array(F.struct(hay.alias("hay"), matched.alias("matched")))
    return posts.withColumn("group_title", F.transform(views, pick)[0]).where("group_title is not null")


def post_lines(posts: DataFrame, title_chars: int = TITLE_CHARS, snippet_chars: int = BODY_CHARS) -> DataFrame:
    """Add ``line`` (date, linked title, start of the body of long posts) and whether the body was cut."""
    raw = strip(F.coalesce(F.nullif("text", F.lit("")), F.lit(DEFAULT_POST)))

    def build(r: Column) -> Column:
        n = F.char_length(r)
        flat = strip(F.replace(F.substring(r, 1, title_chars), F.lit("\n"), F.lit(" ")))
        title = F.when(n > title_chars, F.concat(flat, F.lit("…"))).otherwise(flat)
        cut = (n > title_chars) & (n > snippet_chars) if snippet_chars > 0 else F.lit(False)
        body = F.when(cut, F.concat(F.substring(r, 1, snippet_chars), F.lit("…"))).otherwise(r)
        second = F.when(n > title_chars, F.concat(F.lit("\n  "), F.replace(body, F.lit("\n"), F.lit(" ")))).otherwise(F.lit(""))
        head = F.concat(F.lit("- "), day_text(F.col("published_at")), F.lit(" | "), linked(title, F.col("post_url")))
        return F.struct(F.concat(head, second).alias("line"), cut.alias("truncated"))

    out = F.transform(F.array(raw), build)[0]
    return posts.withColumn("_o", out).withColumns({"line": F.col("_o.line"), "truncated": F.col("_o.truncated")}).drop("_o")


def group_post_text(grouped: DataFrame) -> DataFrame:
    """(group_title, post_no, block): the numbered posts of each report group, undated ones last."""
    dated = grouped.withColumn("_undated", F.col("published_at").isNull())
    rows = ranked(dated, ["group_title"], ["_undated", "published_at", "post_id"], "post_no")
    when = F.when(F.col("published_at").isNotNull(), F.concat(F.lit("Дата: "), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
    link = F.when(F.coalesce("post_url", F.lit("")) != "", F.concat(F.lit("Ссылка: "), F.col("post_url")))
    block = F.concat_ws("\n", F.concat(F.lit("--- Пост "), F.col("post_no").cast("string"), F.lit(" ---")), when, link,
                        F.nullif(clean_post_text(F.col("text")), F.lit("")))
    return rows.select("group_title", "post_no", block.alias("block"))


def date_span(posts: DataFrame, by: Sequence[str]) -> DataFrame:
    return posts.groupBy(*by).agg(F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


def with_latest_summary(profiles: DataFrame, posts: DataFrame, summaries: DataFrame, entities: DataFrame) -> DataFrame:
    """Profiles with the name of their competitor, the number of posts and the status of the latest summary."""
    counts = posts.groupBy("profile_id").agg(F.count(F.lit(1)).alias("posts_count"))
    latest = latest_per_key(summaries.select("profile_id", "summary_id", "created_at", "status"), ["profile_id"],
                            ["created_at", "summary_id"]).select("profile_id", F.col("status").alias("summary_status"))
    names = entities.select(F.col("entity_id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    out = attach(profiles, names, ["competitor_id"]).join(counts, "profile_id", "left").join(latest, "profile_id", "left")
    return out.withColumns({"competitor_name": F.coalesce("competitor_name", F.col("competitor_id").cast("string")),
                            "posts_count": F.coalesce("posts_count", F.lit(0))})


def active_without_profile(entities: DataFrame, profiles: DataFrame) -> DataFrame:
    return entities.where("is_active").join(
        profiles.select(F.col("competitor_id").alias("entity_id")), "entity_id", "left_anti")


def run_stats(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of a collecting run: fetched, matched, inserted, skipped, truncated (boolean columns, NULL = no)."""
    flags = [c for c in ("matched", "inserted", "skipped", "truncated") if c in rows.columns]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("fetched"), *[F.count_if(c).alias(c) for c in flags])


def retention(reports: DataFrame, now: Column, keep_days: int, keep_count: int) -> DataFrame:
    """Add newest_rank and removed: older than ``keep_days`` or beyond the newest ``keep_count``; 0 turns a rule off."""
    rows = ranked(reports.withColumn("_age", -F.unix_micros("created_at")), [], ["_age", "report_id"], "newest_rank").drop("_age")
    old = (F.col("created_at") < now - F.make_dt_interval(days=F.lit(keep_days))) if keep_days > 0 else F.lit(False)
    over = (F.col("newest_rank") > keep_count) if keep_count > 0 else F.lit(False)
    return rows.withColumn("removed", F.coalesce(old, F.lit(False)) | over)
