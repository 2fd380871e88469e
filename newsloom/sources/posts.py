"""Channel, bot and wall payloads to item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_auto
from ..functions.text import head_chars, normalize_text, strip

TEXT_PART = "struct<text:string>"
BOT_MESSAGE = (f"struct<message_id:string,messageId:string,id:string,text:string,body:{TEXT_PART},payload:{TEXT_PART},"
               "url:string,link:string,created_at:string,createdAt:string,date:string,timestamp:string>")
WALL_POST = f"struct<id:bigint,owner_id:bigint,text:string,date:bigint,copy_history:array<{TEXT_PART}>>"
WALL = f"response struct<items:array<{WALL_POST}>>, error struct<error_code:int,error_msg:string>"


def _first(*cols: Column) -> Column:
    return F.coalesce(*[F.when(strip(c) != "", c) for c in cols])


def channel_messages(messages: DataFrame, channel: Column) -> DataFrame:
    """Messages (message_id, text, published_at) of a channel as items; blank ones are left out."""
    name = F.regexp_replace(channel, "^@+", "")
    text = normalize_text(F.col("text"))
    rows = messages.withColumns({"content_text": text, "author": name})
    return rows.where("content_text <> ''").select(
        *[c for c in messages.columns if c != "text"], "author",
        F.concat(F.lit("https://t.me/"), F.col("author"), F.lit("/"), F.col("message_id").cast("string")).alias("url"),
        head_chars(F.col("content_text"), 120).alias("title"), head_chars(F.col("content_text"), 300).alias("snippet"),
        "content_text")


def bot_messages(payloads: DataFrame) -> DataFrame:
    """Messages in bot API answers (source_id, channel_id, body, fetched_at): an array, or an object holding one.

    (source_id, channel_id, message_id, url, title, content_text, published_at, fetched_at); messages without an id or
    text are left out.
    """
    names = ["messages", "items", "data", "results"]
    holder = F.from_json("body", ", ".join(f"{n} array<{BOT_MESSAGE}>" for n in names))
    listed = F.when(F.col("body").rlike(r"^\s*\["), F.from_json("body", f"array<{BOT_MESSAGE}>")).otherwise(
        F.coalesce(*[holder[n] for n in names]))
    fetched = [c for c in ("fetched_at",) if c in payloads.columns]
    m = payloads.select("source_id", "channel_id", *fetched, F.explode(listed).alias("m"))
    rows = m.select(
        "source_id", "channel_id", *fetched,
        strip(_first(F.col("m.message_id"), F.col("m.messageId"), F.col("m.id"))).alias("message_id"),
        normalize_text(_first(F.col("m.text"), F.col("m.body.text"), F.col("m.payload.text"))).alias("content_text"),
        strip(_first(F.col("m.url"), F.col("m.link"))).alias("link"),
        epoch_auto(_first(F.col("m.created_at"), F.col("m.createdAt"), F.col("m.date"), F.col("m.timestamp"))).alias("published_at"))
    rows = rows.where("message_id is not null and content_text <> ''")
    own = F.concat(F.lit("max://"), F.col("channel_id"), F.lit("/"), F.col("message_id"))
    return rows.select("source_id", "channel_id", "message_id", F.coalesce("link", own).alias("url"),
                       head_chars(F.col("content_text"), 120).alias("title"), "content_text", "published_at", *fetched)


def wall_posts(payloads: DataFrame) -> DataFrame:
    """Posts in wall API answers (source_id, body, fetched_at): reposts stand in for an empty text."""
    fetched = [c for c in ("fetched_at",) if c in payloads.columns]
    x = payloads.select("source_id", *fetched, F.from_json("body", WALL).alias("x")).where("x.error is null")
    p = x.select("source_id", *fetched, F.explode("x.response.items").alias("p")).where("p.id > 0")
    text = normalize_text(_first(F.col("p.text"), F.get("p.copy_history", F.lit(0))["text"]))
    rows = p.select(
        "source_id", *fetched, F.col("p.id").alias("message_id"), text.alias("content_text"),
        F.concat(F.lit("https://vk.com/wall"), F.coalesce("p.owner_id", F.lit(0)).cast("string"), F.lit("_"),
                 F.col("p.id").cast("string")).alias("url"),
        F.when(F.coalesce("p.date", F.lit(0)) != 0, F.timestamp_seconds("p.date")).alias("published_at"))
    return rows.where("content_text <> ''").withColumn("title", head_chars(F.col("content_text"), 120))


def wall_errors(payloads: DataFrame) -> DataFrame:
    """(source_id, error) of answers that report an error instead of posts."""
    x = payloads.select("source_id", F.from_json("body", WALL).alias("x")).where("x.error is not null")
    return x.select("source_id", F.concat(F.lit("VK API error: "), F.coalesce("x.error.error_msg", F.to_json("x.error"))).alias("error"))
