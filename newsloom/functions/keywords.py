"""Keyword lists and keyword hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CLASS, strip


def parse_keyword_text(c: Column) -> Column:
    """Keywords from one string, separated by commas, semicolons or any whitespace."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), rf"(?:[,;]|{SPACE_CLASS})+")
    return F.filter(parts, lambda p: p != "")


def parse_keyword_list(c: Column) -> Column:
    """Keywords from an array: lower case, trimmed, blanks dropped; NULL gives an empty array."""
    words = F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda p: strip(F.lower(p)))
    return F.filter(words, lambda p: p.isNotNull() & (p != ""))


def ordered_union(*arrays: Column) -> Column:
    """Concatenation without repeats, first occurrence kept in place."""
    return F.array_distinct(F.concat(*arrays))


def keyword_hits(text: Column, keywords: Column, whole_words: Column) -> Column:
    """The keywords that occur in ``text`` (already lower case), in list order."""
    def hit(k: Column) -> Column:
        quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(k, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
        # the cheap substring test decides first; the pattern is only built for words that do occur
        return F.contains(text, k) & (~whole_words | F.rlike(text, quoted))

    return F.filter(keywords, lambda k: (k != "") & hit(k))
