"""Timestamp and reporting-period columns. All times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Month names in the genitive case, and their three-letter forms.
MONTHS_GENITIVE = ["января", "февраля", "марта", "апреля", "мая", "июня",
                   "июля", "августа", "сентября", "октября", "ноября", "декабря"]
MONTHS_SHORT = ["янв", "фев", "мар", "апр", "май", "июн", "июл", "авг", "сен", "окт", "ноя", "дек"]
LAST_PERIOD = (9999, 99, 99)

ISO_TS = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:[+-]\d{2}:?\d{2})?)?$"
DATE_TEXT = r"\d{1,2}\s+(?:" + "|".join(MONTHS_GENITIVE) + r")\s+\d{4}\s*г\."
DATE_RANGE = r"(?iu)(" + DATE_TEXT + r"(?:\s*-\s*" + DATE_TEXT + r")?)"


def period_month(ts: Column, fallback: Column) -> Column:
    """First day of the month of ``ts``, else of ``fallback``."""
    return F.trunc(F.coalesce(ts, fallback), "MM")


def parse_iso_ts(c: Column) -> Column:
    """ISO-8601 text to timestamp; ``Z`` is accepted, a missing zone means UTC, other text gives NULL."""
    s = F.regexp_replace(c, "Z", "+00:00")
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?!:)", "$1:00")
    zoned = s.rlike(r"\d{2}:\d{2}.*[+-]\d{2}:?\d{2}$")
    with_time = F.when(s.rlike(r"[T ]"), s).otherwise(F.concat(s, F.lit("T00:00:00")))
    full = F.when(zoned, s).otherwise(F.concat(with_time, F.lit("+00:00")))
    return F.when(s.rlike(ISO_TS), F.regexp_replace(full, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))


def epoch_auto(c: Column) -> Column:
    """Text holding epoch seconds, epoch milliseconds (above 10^10) or an ISO timestamp."""
    n = c.try_cast("double")
    seconds = F.when(n > F.lit(1e10), n / 1000).otherwise(n)
    return F.when(n.isNotNull(), F.timestamp_micros(F.round(seconds * 1_000_000).cast("long"))).otherwise(parse_iso_ts(c))


def period_sort_key(c: Column) -> Column:
    """Period label to struct<y,m,d>, ordered by time; unknown labels sort last.

    The year sign is dropped before the month is read, so a dotted short August loses its last letter and is
    unknown, and so are months named in the nominative without a day; both sort last.
    """
    s = strip(F.regexp_replace(F.lower(strip(F.regexp_extract(c, r"(?s)^(.*?)(?: - .*)?$", 1))), r"г\.", ""))

    def num(pattern: str, group: int) -> Column:
        return F.regexp_extract(s, pattern, group).try_cast("int")

    def key(y: Column, m: Column, d: Column) -> Column:
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))

    short = r"(" + "|".join(MONTHS_SHORT) + r")\.?\s*(\d{4})"
    iso = r"(\d{4})-(\d{1,2})(?:-(\d{1,2}))?"
    day_year = r"(\d{1,2})\s+.*?(\d{4})"
    short_month = F.array_position(F.lit(MONTHS_SHORT), F.regexp_extract(s, short, 1)).cast("int")
    word_month = F.lit(None).cast("int")
    for i in range(12, 0, -1):
        names = [MONTHS_SHORT[i - 1]] + (["мая"] if i == 5 else [])
        hit = F.contains(s, F.lit(names[0])) | F.contains(s, F.lit(names[-1]))
        word_month = F.when(hit, F.lit(i)).otherwise(word_month)
    cap = lambda d: F.least(d, F.lit(31))
    return (F.when(s.rlike(r"^\d{4}$"), key(s.try_cast("int"), F.lit(1), F.lit(1)))
            .when(s.rlike(short), key(num(short, 2), short_month, F.lit(1)))
            .when(word_month.isNotNull() & s.rlike(day_year), key(num(day_year, 2), word_month, cap(num(day_year, 1))))
            .when(s.rlike(iso), key(num(iso, 1), num(iso, 2), cap(F.coalesce(num(iso, 3), F.lit(1)))))
            .otherwise(key(*[F.lit(v) for v in LAST_PERIOD])))


def period_label(d: Column) -> Column:
    """Date as day, genitive month name and year, with the year sign."""
    return F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), F.element_at(F.lit(MONTHS_GENITIVE), F.month(d)),
                    F.lit(" "), F.year(d).cast("string"), F.lit(" г."))


def month_bounds(c: Column) -> Column:
    """``YYYY-MM`` (2000–2100) to struct<date_from,date_to,period_month>, else NULL."""
    ok = c.rlike(r"^\d{4}-\d{2}$")
    first = F.when(ok, F.concat(c, F.lit("-01"))).try_cast("date")
    inside = first.isNotNull() & F.year(first).between(2000, 2100)
    return F.when(inside, F.struct(first.alias("date_from"), F.last_day(first).alias("date_to"),
                                   first.alias("period_month")))


def serial_or_date_label(number: Column, day: Column, text: Column) -> Column:
    """Spreadsheet cell to text: dates and day serials above 30000 as period labels, else trimmed text."""
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int"))
    return (F.when(day.isNotNull(), period_label(day))
            .when(number > 30000, period_label(serial))
            .otherwise(F.coalesce(strip(text), number.cast("string"), F.lit(""))))
