"""Text columns: whitespace, hashing, clean-up and small classifications."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace plus the four ASCII separators, emoji ranges, line breaks.
SPACE_CLASS = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE00}-\x{FEFF}]+"
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SUBSCRIBE_WORDS = r"(?iu)подпишитесь|подписывайтесь|подписаться"
FOOTER_NAMES = r"(?iu)ерз|max"
URL_IN_TEXT = r"(?U)https?://\S+|www\.\S+"
MD_LINK = r"\[([^\]]+)\]\((https?://[^)\s]+)\)"

# Error text parts per category, tested in this order.
ERROR_CATEGORIES = [
    ("not_configured", ["credentials not configured"]),
    ("connection", ["connection to telegram failed"]),
    ("unauthorized", ["session is not authorized"]),
    ("missing_keys", []),
    ("flood", ["floodwait"]),
    ("not_found", ["no user has", "username not occupied", "username invalid"]),
    ("no_access", ["could not find the input entity"]),
]

# Fact sections and the word parts that select them, tested in this order.
FACT_SECTIONS = [
    ("Маркетинг и продажи",
     ["акци", "скид", "распрод", "sale", "день монтаж", "мероприят", "выставк", "вебинар", "webinar", "промо"]),
    ("Развитие компании и география",
     ["склад", "регион", "партнёр", "партнер", "команда", "коллектив", "логист", "дилер", "представит"]),
    ("Репутация и риски",
     ["суд", "риск", "претенз", "сертиф", "гарант", "стандарт", "gost", "гост"]),
]
FACT_DEFAULT = "Продукт и ассортимент"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once per row, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Trim every kind of Unicode whitespace (``trim`` alone knows only the plain space)."""
    return F.trim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


ASCII_SPACES, WIDE_SPACES = [c for c in SPACES if c < " "], [c for c in SPACES if c > " "]


def normalize_text(c: Column) -> Column:
    """Collapse whitespace runs to one space and trim; NULL becomes the empty string.

    Substring searches tell the rare texts with non-ASCII whitespace apart, so that the others avoid the
    slow character class.
    """
    def collapse(t: Column) -> Column:
        plain = t
        for space in ASCII_SPACES:
            plain = F.replace(plain, F.lit(space), F.lit(" "))
        spaced = F.when(contains_any(t, WIDE_SPACES), F.regexp_replace(t, SPACE_CLASS, " ")).otherwise(plain)
        return F.regexp_replace(spaced, " {2,}", " ")

    return F.trim(let(F.coalesce(c, F.lit("")), collapse))


def text_sha256(c: Column) -> Column:
    """Hex SHA-256 of the normalised text, NULL when nothing is left of it."""
    return let(normalize_text(c), lambda n: F.when(n != "", F.sha2(n, 256)))


def head_chars(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def item_title(c: Column) -> Column:
    return head_chars(normalize_text(c), 120)


def item_snippet(c: Column) -> Column:
    return head_chars(normalize_text(c), 300)


def tagging_text(c: Column) -> Column:
    """Lower-case text without URLs, in which entity and region terms are looked up."""
    def without_urls(low: Column) -> Column:
        some = F.contains(low, F.lit("://")) | F.contains(low, F.lit("www."))
        return F.when(some, F.regexp_replace(low, URL_IN_TEXT, " ")).otherwise(low)

    return let(F.lower(F.coalesce(c, F.lit(""))), without_urls)


def strip_emoji(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), EMOJI, ""))


def clean_post_text(c: Column) -> Column:
    """Drop emoji, blank lines and channel footers; remaining lines are joined by a blank line."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), EMOJI, "")
    lines = F.transform(F.split(text, LINE_BREAK), strip)
    kept = F.filter(lines, lambda x: (x != "") & ~(x.rlike(SUBSCRIBE_WORDS) & x.rlike(FOOTER_NAMES)))
    return F.array_join(kept, "\n\n")


def md_links(c: Column) -> Column:
    """``[label](http…)`` occurrences as array<struct<label,url>>."""
    text = F.coalesce(c, F.lit(""))
    labels = F.regexp_extract_all(text, F.lit(MD_LINK), F.lit(1))
    urls = F.regexp_extract_all(text, F.lit(MD_LINK), F.lit(2))
    return F.zip_with(labels, urls, lambda a, b: F.struct(a.alias("label"), b.alias("url")))


def contains_any(c: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(c, F.lit(p))
    return hit


def classify_error(c: Column) -> Column:
    """Category of a collector error text; NULL for NULL or blank text."""
    low = F.lower(strip(c))
    tests = {name: contains_any(low, parts) for name, parts in ERROR_CATEGORIES}
    tests["unauthorized"] |= F.contains(low, F.lit("not authorized")) & F.contains(low, F.lit("telegram"))
    tests["missing_keys"] = (F.contains(low, F.lit("api_id")) & F.contains(low, F.lit("api_hash"))
                             & F.contains(low, F.lit("обязательны")))
    out = F.when(c.isNull() | (low == ""), F.lit(None).cast("string"))
    for name, _ in ERROR_CATEGORIES:
        out = out.when(tests[name], F.lit(name))
    return out.otherwise(F.lit("other"))


def classify_fact(c: Column) -> Column:
    """Report subsection a fact belongs to, by the first keyword group that occurs in it."""
    def pick(low: Column) -> Column:
        (first, parts), *rest = FACT_SECTIONS
        out = F.when(contains_any(low, parts), F.lit(first))
        for name, words in rest:
            out = out.when(contains_any(low, words), F.lit(name))
        return out.otherwise(F.lit(FACT_DEFAULT))

    return let(F.lower(F.coalesce(c, F.lit(""))), pick)
