"""URL filters: allow and block rules in a trie over reversed host labels and path segments, longest match wins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER

#: characters of rules in one broadcast trie; more rules go to further tries, each of them bounded
TRIE_CHARS = 8_000_000

# The rules of the registered query, as (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

RESULT = "labels int, path_chars int, rule string, verdict string"


class UrlTrie:
    """Host labels from the right lead to a node; its path part is a trie of whole segments with open ends.

    ``tails`` of a path node are the rules that end there: the last, possibly unfinished, segment of the rule. The host
    counts first (more labels win), then the length of the path; of rules for the same place the first stays.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.top: dict = {"next": {}, "paths": None}
        for verdict, host, path in rules:
            node = self.top
            for label in reversed(host.split(".")) if host else ():
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "tails": {}}
            node = node["paths"]
            *whole, tail = path.split("/")
            for segment in whole:
                node = node["next"].setdefault(segment, {"next": {}, "tails": {}})
            node["tails"].setdefault(tail, (host + path, verdict))

    def longest(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path length, rule, verdict) of the longest rule that fits."""
        best, node = None, self.top
        segments = path.split("/")
        labels = host.split(".")
        for depth in range(len(labels) + 1):
            if depth:
                node = node["next"].get(labels[-depth])
                if node is None:
                    break
            if node["paths"] is not None:
                best = self._longest_path(node["paths"], segments, depth) or best
        return best

    @staticmethod
    def _longest_path(node: dict, segments: list[str], depth: int):
        found, length = None, 0
        for segment in segments:
            fits = [t for t in node["tails"] if segment.startswith(t)]
            if fits:
                tail = max(fits, key=len)
                found = (depth, length + len(tail), *node["tails"][tail])
            node = node["next"].get(segment)
            if node is None:
                break
            length += len(segment) + 1
        return found


def bounded_tries(rules: Iterable[tuple[str, str, str]], limit: int = TRIE_CHARS) -> Iterator[list[tuple[str, str, str]]]:
    part, size = [], 0
    for rule in rules:
        size += len(rule[1]) + len(rule[2])
        if part and size > limit:
            yield part
            part, size = [], len(rule[1]) + len(rule[2])
        part.append(rule)
    if part:
        yield part


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _match(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    made = []

    @F.pandas_udf(RESULT)
    def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(UrlTrie(rules))
        hits = [made[0].longest(h, p) or (None, None, None, None) for h, p in zip(hosts, paths)]
        return pd.DataFrame(hits, columns=["labels", "path_chars", "rule", "verdict"])

    return match(host, path)


def filter_urls(rows: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", keep: Iterable[str] = (),
                otherwise: str = "allow", limit: int = TRIE_CHARS) -> DataFrame:
    """The columns ``keep`` of ``rows``, then host, path, rule and verdict for every row.

    ``rules`` are (verdict, host, path); a rule fits its host and all subdomains when the path starts with the rule's.
    More host labels win, then the longer path. Urls that are null or lack ``://`` have an empty host and path; only a rule
    with an empty host could fit them. Without a fitting rule: rule null, verdict ``otherwise``. Repeated rows are judged one by one;
    an empty table stays empty; columns not in ``keep`` are ignored, whatever their names.
    """
    keep = list(keep)
    found = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(url).alias("_u"))
    found = found.withColumns({"host": host_of(F.col("_u")), "path": path_of(F.col("_u"))})
    names = []
    for i, part in enumerate(bounded_tries(rules, limit)):
        found = found.withColumn(f"m{i}", _match(part, F.col("host"), F.col("path")))
        names.append(f"m{i}")
    none = F.lit(None).cast(f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>")
    matched = [F.when(F.col(f"{m}.rule").isNotNull(), F.col(m)) for m in names] or [none]
    best = F.greatest(*matched) if len(matched) > 1 else matched[0]
    found = found.withColumn("best", best)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("best.rule").alias("rule"),
                        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
