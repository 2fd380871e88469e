"""Entity mentions and region scores by term dictionaries.

A small dictionary is compiled into one constant expression, so tagging is a projection of the item scan: no join, no
shuffle, no Python. Its cost is terms × text, so beyond ``SCAN_TERMS`` terms an Aho-Corasick automaton reads each text once
instead, in Arrow batches. Dictionaries are fetched and applied in slices of bounded size; the answer depends on neither.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, strip, tagging_text
from ..scale import attach

# What counts as a word character, the longest term matched as a whole word,
# and the words too general to point at a region.
WORD = "a-z0-9а-яё"
SHORT_TERM = 3
GENERIC_GEO_TERMS = ["республика", "народная", "национальная", "область", "край", "округ",
                     "город", "район", "фо", "россия", "рф"]

#: terms up to which a dictionary is searched term by term, and characters of terms in one slice
SCAN_TERMS = 200
SLICE_CHARS = 4_000_000
WORD_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789" + "".join(map(chr, range(ord("а"), ord("я") + 1))) + "ё")


class Scanner:
    """A slice of a dictionary and its automaton, made once in each Python worker: a broadcast object outlives the tasks of a worker."""

    def __init__(self, entries: "Entries", patterns: Callable[["Entries"], dict]):
        self.entries, self.patterns, self.built = entries, patterns, None

    def __getstate__(self):
        return {"entries": self.entries, "patterns": self.patterns, "built": None}

    def scan(self) -> "TermScan":
        if self.built is None:
            self.built = TermScan(self.patterns(self.entries))
        return self.built


def _shared(entries: "Entries", patterns: Callable[["Entries"], dict]):
    return SparkSession.active().sparkContext.broadcast(Scanner(entries, patterns))


def entity_terms(entities: DataFrame) -> DataFrame:
    """(entity_id, terms) of the active entities: name, aliases and tags."""
    none = F.expr("cast(array() as array<string>)")
    return entities.where("is_active").select(
        F.col("entity_id").cast("string").alias("entity_id"),
        F.concat(F.array("name"), F.coalesce("aliases", none), F.coalesce("tags", none)).alias("terms"))


def region_terms(regions: DataFrame) -> DataFrame:
    """(region_id, terms) of the active regions; a term listed twice counts twice."""
    none = F.expr("cast(array() as array<string>)")
    return regions.where("is_active").select(
        F.col("region_id").cast("string").alias("region_id"),
        F.concat(*[F.coalesce(c, none) for c in ("federal_subjects", "keywords", "geographic_aliases")]).alias("terms"))


Entries = list[tuple[str, list[str]]]


def _dictionary(terms: DataFrame, key: str) -> Iterator[Entries]:
    """Slices of (key, terms) in key order, each of at most SLICE_CHARS characters (or one key); fetched partition by partition."""
    rows = terms.select(F.col(key).alias("key"), F.transform("terms", lambda t: strip(F.lower(F.coalesce(t, F.lit(""))))).alias("terms")).orderBy("key", "terms")
    run, n = [], 0
    for r in rows.toLocalIterator():
        words = [t for t in r.terms if t]
        size = sum(map(len, words)) + len(words)
        if run and n + size > SLICE_CHARS:
            yield run
            run, n = [], 0
        run.append((r.key, words))
        n += size
    if run:
        yield run


def _few(entries: Entries) -> bool:
    return sum(len(terms) for _, terms in entries) <= SCAN_TERMS


class TermScan:
    """All terms of a slice in one pass over a text. ``patterns`` maps a string to the uses made of it, with its boundary rule."""

    def __init__(self, patterns: dict[str, list[tuple[str, object]]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, uses in patterns.items():
            self.automaton.add_word(p, (len(p), uses))
        self.automaton.make_automaton()

    def hits(self, text: str) -> set:
        found = set()
        if not text or not len(self.automaton):
            return found
        for last, (n, uses) in self.automaton.iter(text):
            for rule, use in uses:
                if use in found:
                    continue
                begin = last - n + 1
                if rule != "any" and begin > 0 and text[begin - 1] in WORD_CHARS:
                    continue
                if rule == "alone" and last + 1 < len(text) and text[last + 1] in WORD_CHARS:
                    continue
                found.add(use)
        return found


def _constant(value: object, ddl: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def _alone(term: str) -> str:
    return rf"(?<![{WORD}])\Q{term}\E(?![{WORD}])"


def _at_word_start(term: str) -> str:
    return rf"(?<![{WORD}])\Q{term}\E"


def mentions(text: Column, slices: Iterator[Entries]) -> Column:
    """Ids whose terms occur in ``text`` (from ``tagging_text``), sorted.

    Terms up to three characters must stand alone; longer ones match anywhere.
    """
    parts = [_mentions_slice(text, s) if _few(s) else _mentions_scan(text, s) for s in slices]
    none = F.expr("cast(array() as array<string>)")
    return F.array_sort(F.concat(*parts)) if parts else none


def _mention_patterns(entries: Entries) -> dict:
    patterns = {}
    for i, (_, terms) in enumerate(entries):
        for t in terms:
            patterns.setdefault(t, []).append(("alone" if len(t) <= SHORT_TERM else "any", i))
    return patterns


def _mentions_scan(text: Column, entries: Entries) -> Column:
    shared = _shared(entries, _mention_patterns)

    @F.pandas_udf("array<string>")
    def scan(texts: pd.Series) -> pd.Series:
        terms, known = shared.value.scan(), shared.value.entries
        return pd.Series([[known[i][0] for i in sorted(terms.hits(t))] for t in texts])

    return F.when(text.isNotNull(), scan(text)).otherwise(F.expr("cast(array() as array<string>)"))


def _mentions_slice(text: Column, entries) -> Column:
    spec = [{"id": k, "long": [t for t in terms if len(t) > SHORT_TERM],
             "short": [{"t": t, "alone": _alone(t)} for t in terms if len(t) <= SHORT_TERM]} for k, terms in entries]
    table = _constant(spec, "array<struct<id:string,long:array<string>,short:array<struct<t:string,alone:string>>>>")

    def look(hay: Column) -> Column:
        def hit(e: Column) -> Column:
            # the substring search is cheap; the pattern only runs where the letters occur at all
            return (F.exists(e["long"], lambda t: F.contains(hay, t))
                    | F.exists(e["short"], lambda t: F.contains(hay, t["t"]) & F.rlike(hay, t["alone"])))

        return F.transform(F.filter(table, hit), lambda e: e["id"])

    return let(text, look)


def tag_entities(items: DataFrame, entities: DataFrame, text: Column, out: str = "mentions") -> DataFrame:
    """Add the sorted ids of the active entities that occur in ``text``."""
    return items.withColumn(out, mentions(tagging_text(text), _dictionary(entity_terms(entities), "entity_id")))


def item_text() -> Column:
    return F.array_join(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("title", "content_text", "snippet")]), " ")


def confirm_mentions(items: DataFrame, entities: DataFrame, column: str = "mentions") -> DataFrame:
    """Keep, in order, the stored mention ids whose active entity still occurs in the item."""
    found = mentions(tagging_text(item_text()), _dictionary(entity_terms(entities), "entity_id"))
    both = F.transform(F.array(F.struct(F.col(column).alias("old"), found.alias("now"))),
                       lambda p: F.filter(p["old"], lambda m: F.array_contains(p["now"], m.cast("string"))))
    return items.withColumn(column, both[0])


def mention_names(items: DataFrame, entities: DataFrame, column: str = "mentions", out: str = "mention_names",
                  item_id: str = "item_id") -> DataFrame:
    """Add the names of the mentioned entities in mention order; unknown ids are dropped."""
    names = entities.select(F.col("entity_id").alias("_id"), F.col("name").alias("_name"))
    rows = items.select(item_id, F.posexplode(column).alias("_pos", "_id"))
    known = attach(rows, names, ["_id"], "inner")
    ordered = known.groupBy(item_id).agg(F.array_sort(F.collect_list(F.struct("_pos", "_name"))).alias("_n"))
    joined = items.join(ordered.select(item_id, F.col("_n._name").alias(out)), item_id, "left")
    return joined.withColumn(out, F.coalesce(out, F.expr("cast(array() as array<string>)")))


# --- regions -----------------------------------------------------------------------------------------

def _usable(term: str) -> bool:
    return len(term) >= 2 and term not in GENERIC_GEO_TERMS


def region_scores(title: Column, body: Column, slices: Iterator[Entries]) -> Column:
    """array<struct<region_id,score>> of the regions with a positive score, rounded to 6 digits.

    A title hit is worth 4 to 6 points, a hit in the first 300 characters of the body about 1.2 to 2.2,
    one further down 0.45 to 0.8; longer terms weigh more.
    """
    parts = [_scores_slice(title, body, s) if _few(s) else _scores_scan(title, body, s) for s in slices]
    empty = F.expr("cast(array() as array<struct<region_id:string,score:double>>)")
    return F.concat(*parts) if parts else empty


def _score_patterns(entries: Entries) -> dict:
    patterns = {}
    for i, (_, terms) in enumerate(entries):
        for j, t in enumerate(filter(_usable, terms)):
            use = (i, j, min(len(t), 16) / 16.0)
            if len(t) <= SHORT_TERM:
                patterns.setdefault(t, []).append(("alone", use))
            else:
                patterns.setdefault(t, []).append(("any", use))
                patterns.setdefault(t[:-1], []).append(("start", use))
    return patterns


def _scores_scan(title: Column, body: Column, entries: Entries) -> Column:
    shared = _shared(entries, _score_patterns)

    @F.pandas_udf("array<struct<region_id:string,score:double>>")
    def scan(titles: pd.Series, bodies: pd.Series) -> pd.Series:
        terms, known, out = shared.value.scan(), shared.value.entries, []
        for title_, body_ in zip(titles, bodies):
            top, body_ = terms.hits(title_ or ""), body_ or ""
            head = terms.hits(body_[:300])
            whole = terms.hits(body_)
            scores: dict[int, float] = {}
            for use in sorted(top | head | whole):
                i, _, s = use
                in_title = 4.0 + s * 2.0 if use in top else 0.0
                in_body = 1.2 + s if use in head else 0.45 + s * 0.35 if use in whole else 0.0
                scores[i] = scores.get(i, 0.0) + in_title + in_body
            out.append([{"region_id": known[i][0], "score": scores[i]} for i in sorted(scores)])
        return pd.Series(out)

    return F.transform(scan(title, body), lambda r: F.struct(r["region_id"].alias("region_id"), F.round(r["score"], 6).alias("score")))


def _scores_slice(title: Column, body: Column, entries) -> Column:
    spec = []
    for key, terms in entries:
        rows = []
        for t in filter(_usable, terms):
            short = len(t) <= SHORT_TERM
            stem = t if short else t[:-1]
            rows.append({"s": min(len(t), 16) / 16.0, "stem": stem, "whole": None if short else t,
                         "at": _alone(t) if short else _at_word_start(stem)})
        spec.append({"id": key, "terms": rows})
    table = _constant(spec, "array<struct<id:string,terms:array<struct<s:double,stem:string,whole:string,at:string>>>>")

    def hit(text: Column, t: Column) -> Column:
        # a long term anywhere, or without its last letter at the start of a word; a short one standing alone
        return F.contains(text, t["stem"]) & (F.coalesce(F.contains(text, t["whole"]), F.lit(False)) | F.rlike(text, t["at"]))

    def look(hay: Column) -> Column:
        def points(total: Column, t: Column) -> Column:
            in_title = F.when(hit(hay["title"], t), 4.0 + t["s"] * 2.0).otherwise(0.0)
            in_body = (F.when(hit(hay["head"], t), 1.2 + t["s"])
                       .when(hit(hay["body"], t), 0.45 + t["s"] * 0.35).otherwise(0.0))
            return total + in_title + in_body

        scored = F.transform(table, lambda r: F.struct(
            r["id"].alias("region_id"), F.round(F.aggregate(r["terms"], F.lit(0.0), points), 6).alias("score")))
        return F.filter(scored, lambda r: r["score"] > 0)

    return let(body, lambda b: let(
        F.struct(title.alias("title"), F.substring(b, 1, 300).alias("head"), b.alias("body")), look))


SOURCE_BONUS = 3.0


def with_source_bonus(scores: Column, source_regions: Column) -> Column:
    """Add the bonus to the region of a single-region source, if that region scored at all."""
    only = F.when(F.size(source_regions) == 1, F.element_at(source_regions, 1).cast("string"))
    return F.transform(scores, lambda r: F.struct(
        r["region_id"].alias("region_id"),
        F.when(r["region_id"] == only, F.round(r["score"] + SOURCE_BONUS, 6)).otherwise(r["score"]).alias("score")))


def score_regions(items: DataFrame, regions: DataFrame, title: Column, body: Column, out: str = "scores") -> DataFrame:
    """Add region scores; items need source_region_ids (empty or NULL when the source has none)."""
    entries = _dictionary(region_terms(regions), "region_id")
    raw = region_scores(tagging_text(title), tagging_text(body), entries)
    return items.withColumn(out, with_source_bonus(raw, F.col("source_region_ids")))


# Least score for a pick, and how near the second region must come.
LEAST_SCORE = 1.0
SECOND_SHARE = 0.88


def pick_regions(items: DataFrame, max_regions: int = 1, scores: str = "scores", out: str = "region_ids") -> DataFrame:
    """Best region (and a close second when allowed), else all regions of the source."""
    def choose(ranked: Column) -> Column:
        second = F.slice(ranked, 2, 1)
        close = F.filter(second, lambda r: r["score"] >= F.round(ranked[0]["score"] * SECOND_SHARE, 6))
        picked = F.concat(F.slice(ranked, 1, 1), close) if max_regions > 1 else F.slice(ranked, 1, 1)
        return F.transform(picked, lambda r: r["region_id"])

    own = F.transform(F.coalesce("source_region_ids", F.expr("cast(array() as array<string>)")),
                      lambda r: r.cast("string"))
    by_score = F.array_sort(F.col(scores), lambda a, b: F.when(a["score"] > b["score"], -1)
                            .when(a["score"] < b["score"], 1)
                            .when(a["region_id"] < b["region_id"], -1)
                            .when(a["region_id"] > b["region_id"], 1).otherwise(0))
    best = F.transform(F.array(by_score), lambda r: F.when(
        (F.size(r) > 0) & (F.get(r, F.lit(0))["score"] >= LEAST_SCORE), choose(r)))[0]
    return items.withColumn(out, F.coalesce(best, own))


def resolve_regions(items: DataFrame, regions: DataFrame, max_regions: int = 1) -> DataFrame:
    """Region ids at ingestion: without a title the first 200 characters of the body stand in for it."""
    title = F.when(F.coalesce(strip(F.col("title")), F.lit("")) == "", F.substring("content_text", 1, 200)).otherwise(
        strip(F.col("title")))
    return pick_regions(score_regions(items, regions, title, F.col("content_text")), max_regions).drop("scores")


def effective_regions(items: DataFrame, regions: DataFrame) -> DataFrame:
    """Region ids at report time: title against text plus snippet, one region at most."""
    body = strip(F.concat_ws(" ", F.coalesce("content_text", F.lit("")), F.coalesce("snippet", F.lit(""))))
    title = strip(F.coalesce("title", F.lit("")))
    return pick_regions(score_regions(items, regions, title, body), 1).drop("scores")
