"""Nested report sections: parsing, clean-up, merging and flattening of JSON payloads.

Merges work on long rows (one per paragraph or bullet), so a report of any size is de-duplicated by grouped
aggregates; nested arrays are built from bounded parts.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_iso_ts
from ..functions.text import blank_to_null, classify_fact, let, strip, strip_emoji
from ..scale import attach, attach_counted, keep_first, order_chunks, scan
from ..session import new_path, stage
from .clusters import connected_components

CITATION = "struct<label:string,url:string>"
BULLET = f"struct<text:string,citations:array<{CITATION}>>"
SUBSECTION = f"struct<title:string,paragraphs:array<string>,bullets:array<{BULLET}>>"
SECTION = (f"struct<headline:string,lead:string,paragraphs:array<string>,bullets:array<{BULLET}>,"
           f"subsections:array<{SUBSECTION}>,closing:string>")
RAW_SUBSECTION = "struct<title:string,paragraphs:array<string>,bullets:array<string>>"
RAW_SECTION = ("struct<headline:string,lead:string,paragraphs:array<string>,bullets:array<string>,"
               "subsections:array<string>,closing:string>")

# Default headline of a merged section, default link label, lengths used for matching facts,
# and the least sizes of an analytical section.
DEFAULT_HEADLINE = "Общие новости"
LINK_LABEL = "источник"
MATCH_CHARS = 160
LEAST_LEAD, LEAST_PARAGRAPHS, LEAST_BULLETS = 180, 200, 6
DATE_RANGE_TITLE = r"\d{4}-\d{2}-\d{2}\s*[—\-–]\s*\d{4}-\d{2}-\d{2}"


def _empty(ddl: str) -> Column:
    return F.expr(f"cast(array() as array<{ddl}>)")


def _object_json(c: Column) -> Column:
    """The text when it is one JSON object, else NULL."""
    return let(F.try_parse_json(c), lambda v: F.when(
        v.isNotNull() & F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), c))


def section_json(raw: Column) -> Column:
    """The JSON object in a model answer: as it is, without its code fence, or the outermost braces."""
    def unfenced(s: Column) -> Column:
        opened = F.regexp_replace(s, r"^```[^\n]*(?:\n|\z)", "")
        inner = strip(F.regexp_replace(opened, r"(?:^|\n)[ \t\r]*```[ \t\r]*\z", ""))
        return F.when(F.startswith(s, F.lit("```")), inner).otherwise(s)

    def braces(u: Column) -> Column:
        return let(F.nullif(F.regexp_extract(u, r"(?s)(\{.*\})", 1), F.lit("")), _object_json)

    return let(strip(F.coalesce(raw, F.lit(""))), lambda s: F.coalesce(
        _object_json(s), let(unfenced(s), lambda u: F.coalesce(_object_json(u), braces(u)))))


def _bullets(c: Column) -> Column:
    """Bullets given as strings or objects to {text, citations}; blank ones are dropped."""
    def clean(text: Column, citations: Column) -> Column:
        return F.struct(strip_emoji(text).alias("text"), F.coalesce(citations, _empty(CITATION)).alias("citations"))

    def one(b: Column) -> Column:
        return F.when(F.startswith(b, F.lit("{")), let(F.from_json(b, BULLET), lambda p: clean(p["text"], p["citations"]))) \
            .otherwise(clean(b, F.lit(None).cast(f"array<{CITATION}>")))

    return F.filter(F.transform(F.coalesce(c, _empty("string")), one), lambda b: b["text"] != "")


def _paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, _empty("string")), strip_emoji), lambda p: p != "")


def _clean_text(c: Column) -> Column:
    return F.nullif(strip_emoji(c), F.lit(""))


def parse_sections(df: DataFrame, raw: str, out: str = "section") -> DataFrame:
    """Add the cleaned section struct parsed from ``raw``; NULL when there is no JSON object in it."""
    def clean(j: Column) -> Column:
        def build(x: Column) -> Column:
            def sub(text: Column) -> Column:
                return let(F.from_json(text, RAW_SUBSECTION), lambda s: F.struct(
                    strip_emoji(s["title"]).alias("title"), _paragraphs(s["paragraphs"]).alias("paragraphs"),
                    _bullets(s["bullets"]).alias("bullets")))

            objects = F.filter(F.coalesce(x["subsections"], _empty("string")), lambda t: F.startswith(t, F.lit("{")))
            subs = F.filter(F.transform(objects, sub), lambda s: (s["title"] != "") | (F.size(s["paragraphs"]) > 0)
                            | (F.size(s["bullets"]) > 0))
            return F.struct(
                _clean_text(x["headline"]).alias("headline"), _clean_text(x["lead"]).alias("lead"),
                _paragraphs(x["paragraphs"]).alias("paragraphs"), _bullets(x["bullets"]).alias("bullets"),
                subs.alias("subsections"), _clean_text(x["closing"]).alias("closing"))

        return let(F.from_json(j, RAW_SECTION), build)

    return df.withColumn(out, let(section_json(F.col(raw)), lambda j: F.when(j.isNotNull(), clean(j))))


def normalize_sections(df: DataFrame, section: str = "section") -> DataFrame:
    """Clean a section struct that is already typed: emoji, blanks, empty subsections."""
    s = F.col(section)

    def paragraphs(c: Column) -> Column:
        return _paragraphs(c)

    def bullets(c: Column) -> Column:
        tidy = F.transform(F.coalesce(c, _empty(BULLET)), lambda b: F.struct(
            strip_emoji(b["text"]).alias("text"), F.coalesce(b["citations"], _empty(CITATION)).alias("citations")))
        return F.filter(tidy, lambda b: b["text"] != "")

    subs = F.transform(F.coalesce(s["subsections"], _empty(SUBSECTION)), lambda x: F.struct(
        strip_emoji(x["title"]).alias("title"), paragraphs(x["paragraphs"]).alias("paragraphs"),
        bullets(x["bullets"]).alias("bullets")))
    full = F.filter(subs, lambda x: (x["title"] != "") | (F.size(x["paragraphs"]) > 0) | (F.size(x["bullets"]) > 0))
    return df.withColumn(section, F.when(s.isNotNull(), F.struct(
        _clean_text(s["headline"]).alias("headline"), _clean_text(s["lead"]).alias("lead"),
        paragraphs(s["paragraphs"]).alias("paragraphs"), bullets(s["bullets"]).alias("bullets"),
        full.alias("subsections"), _clean_text(s["closing"]).alias("closing"))))


# --- long rows ---------------------------------------------------------------------------------------

ROW = f"struct<kind:string,sub_no:int,sub_title:string,pos:int,text:string,citations:array<{CITATION}>>"


def section_rows(parts: DataFrame, keys: Sequence[str], part_no: str = "part_no") -> DataFrame:
    """One row per paragraph and bullet: (keys, part_no, kind, sub_no, sub_title, pos, text, citations).

    sub_no is -1 for the section's own content, else the position of the subsection.
    """
    s = F.col("section")

    def rows(kind: str, values: Column, sub_no: Column, title: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            text, cites = (v["text"], v["citations"]) if kind == "bullet" else (v, _empty(CITATION))
            return F.struct(F.lit(kind).alias("kind"), sub_no.cast("int").alias("sub_no"), title.alias("sub_title"),
                            i.cast("int").alias("pos"), text.alias("text"), cites.alias("citations"))

        return F.transform(values, one)

    top, none = F.lit(-1), F.lit(None).cast("string")

    def of_sub(x: Column, i: Column) -> Column:
        return F.concat(rows("paragraph", x["paragraphs"], i, x["title"]), rows("bullet", x["bullets"], i, x["title"]))

    everything = F.concat(rows("paragraph", s["paragraphs"], top, none), rows("bullet", s["bullets"], top, none),
                          F.flatten(F.transform(s["subsections"], of_sub)))
    return parts.where(s.isNotNull()).select(*keys, F.col(part_no).alias("part_no"), F.inline(everything))


def section_heads(parts: DataFrame, keys: Sequence[str], part_no: str = "part_no") -> DataFrame:
    """(keys, parts, headline, lead, closing) of a merge: first headline and lead, last closing."""
    s = F.col("section")
    heads = parts.where(s.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("parts"), F.min_by(F.struct(s["headline"].alias("headline"), s["lead"].alias("lead")),
                                                   part_no).alias("_first"),
        F.max_by(F.struct(s["closing"].alias("closing")), part_no).alias("_last"))
    headline = F.when(F.col("parts") > 1, F.coalesce("_first.headline", F.lit(DEFAULT_HEADLINE))).otherwise(
        F.col("_first.headline"))
    return heads.select(*keys, "parts", headline.alias("headline"), F.col("_first.lead").alias("lead"),
                        F.col("_last.closing").alias("closing"))


def match_text(c: Column) -> Column:
    return F.substring(F.lower(F.coalesce(c, F.lit(""))), 1, MATCH_CHARS)


def merge_sections(parts: DataFrame, keys: Sequence[str], drafts: bool = False) -> DataFrame:
    """Content rows of merged sections: paragraphs distinct by text, bullets by their first characters.

    Subsections are left out, as a merge drops them; with ``drafts`` their content follows the sections' own.
    A group with a single part keeps all of its rows.
    """
    rows = section_rows(parts, keys)
    counts = stage(parts.where("section is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("_parts")), "parts")
    own = rows.where("sub_no = -1") if not drafts else rows
    key = F.when(F.col("kind") == "bullet", match_text(F.col("text"))).otherwise(strip(F.col("text")))
    ordered = own.withColumns({"_key": key, "_late": (F.col("sub_no") >= 0).cast("int")})
    first = keep_first(ordered.where("_key <> ''"), [*keys, "kind", "_key"], ["_late", "part_no", "sub_no", "pos"])
    merged = attach(first, counts.where("_parts > 1"), keys, "left_semi").drop("_key", "_late")
    single = attach(rows, counts.where("_parts = 1"), keys, "left_semi")
    return merged.unionByName(single)


def assemble_subsections(themes: DataFrame, keys: Sequence[str], position: str = "position") -> tuple[DataFrame, DataFrame]:
    """(heads, rows) of a section made of themes: every theme with content becomes a subsection.

    Headline and lead come from position 0 only, the closing from the last theme that has one. Themes need
    ``title`` and ``section``.
    """
    s = F.col("section")
    full = themes.where(s.isNotNull() & ((F.size(s["bullets"]) > 0) | (F.size(s["paragraphs"]) > 0)))
    first = F.col(position) == 0
    heads = full.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(first, s["headline"])), F.lit(DEFAULT_HEADLINE)).alias("headline"),
        F.max(F.when(first, s["lead"])).alias("lead"),
        F.max_by(s["closing"], F.when(F.coalesce(s["closing"], F.lit("")) != "", F.col(position))).alias("closing"),
        F.count(F.lit(1)).alias("subsections"))
    named = section_rows(full.withColumn("_t", F.struct("title")), [*keys, "_t"], position).where("sub_no = -1")
    rows = named.withColumns({"sub_no": F.col("part_no"), "sub_title": F.col("_t.title")}).drop("_t", "part_no")
    return heads, rows


def merge_time_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Content rows of chronological parts as labelled subsections, a part's own content after its subsections.

    Parts need ``label``; rows come out with sub_title and an order (part_no, sub_no, kind, pos). A group with
    a single part keeps its shape.
    """
    counts = stage(parts.where("section is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("parts")), "parts")
    rows = attach(section_rows(parts.withColumn("_l", F.struct("label")), [*keys, "_l"]), counts, keys, "inner")
    many = F.col("parts") > 1
    own = F.col("sub_no") == -1
    title = F.when(own, F.col("_l.label")).otherwise(F.coalesce(blank_to_null(F.col("sub_title")), F.col("_l.label")))
    return rows.withColumns({
        "sub_title": F.when(many, title).otherwise(F.col("sub_title")),
        "sub_no": F.when(many & own, F.lit(2 ** 31 - 1)).otherwise(F.col("sub_no"))}).drop("_l", "parts")


def bullet_line(b: Column) -> Column:
    links = F.transform(
        F.filter(b["citations"], lambda c: strip(F.coalesce(c["url"], F.lit(""))) != ""),
        lambda c: F.concat(F.lit("["), F.coalesce(F.nullif(c["label"], F.lit("")), F.lit(LINK_LABEL)), F.lit("]("),
                           strip(c["url"]), F.lit(")")))
    return F.concat(F.lit("- "), b["text"], F.when(F.size(links) > 0, F.concat(F.lit(" "), F.array_join(links, " ")))
                    .otherwise(F.lit("")))


def section_text(s: Column) -> Column:
    """Section as text blocks separated by blank lines."""
    def body(x: Column) -> Column:
        return F.concat(x["paragraphs"], F.transform(x["bullets"], bullet_line))

    def sub(x: Column) -> Column:
        head = F.when(x["title"] != "", F.array(F.concat(F.lit("### "), x["title"]))).otherwise(_empty("string"))
        return F.concat(head, body(x))

    blocks = F.concat(F.array(s["headline"], s["lead"]), body(s), F.flatten(F.transform(s["subsections"], sub)),
                      F.array(s["closing"]))
    return F.array_join(F.filter(blocks, lambda b: F.coalesce(b, F.lit("")) != ""), "\n\n")


def sections_to_text(df: DataFrame, out: str = "text") -> DataFrame:
    return df.withColumn(out, section_text(F.col("section")))


def section_quality(df: DataFrame, min_bullets: int = LEAST_BULLETS) -> DataFrame:
    """Add is_analytical: thematic subsections, a long lead, enough paragraph text and enough bullets."""
    s = F.col("section")
    subs = F.coalesce(s["subsections"], _empty(SUBSECTION))
    dated = F.exists(subs, lambda x: F.coalesce(x["title"], F.lit("")).rlike(DATE_RANGE_TITLE))
    chars = F.aggregate(F.flatten(F.transform(subs, lambda x: x["paragraphs"])), F.lit(0),
                        lambda n, p: n + F.char_length(p))
    bullets = F.aggregate(subs, F.lit(0), lambda n, x: n + F.size(x["bullets"]))
    good = (F.size(subs) > 0) & ~dated & (F.char_length(F.coalesce(s["lead"], F.lit(""))) >= LEAST_LEAD) \
        & (chars >= LEAST_PARAGRAPHS) & (bullets >= min_bullets)
    return df.withColumn("is_analytical", F.coalesce(good, F.lit(False)))


def meta_ts(meta: Column, path: str) -> Column:
    """ISO timestamp at a JSON path; missing or invalid gives NULL."""
    return parse_iso_ts(F.get_json_object(meta, path))


# --- facts a summary left out ------------------------------------------------------------------------

def fact_keys(text: Column, citations: Column) -> Column:
    """What two facts may share: the start of their text, or a cited url."""
    start = match_text(text)
    urls = F.filter(F.transform(F.coalesce(citations, _empty(CITATION)), lambda c: strip(F.coalesce(c["url"], F.lit("")))),
                    lambda u: u != "")
    own = F.when(start != "", F.array(F.concat(F.lit("t:"), start))).otherwise(_empty("string"))
    return F.array_distinct(F.concat(own, F.transform(urls, lambda u: F.concat(F.lit("u:"), u))))


def _walk(report: str, types: dict):
    """The sequential rule over the keys of some facts: in order, a fact is taken when none of its keys is."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([report, "fact_no"])
        taken, won, keys, last = set(), [], [], None

        def close():
            if last is not None and taken.isdisjoint(keys):
                taken.update(keys)
                won.append(last)

        for owner, no, key in zip(pdf[report], pdf["fact_no"], pdf["key"]):
            if (owner, no) != last:
                close()
                keys, last = [], (owner, no)
            keys.append((owner, key))
        close()
        return pd.DataFrame(won, columns=[report, "fact_no"])

    return run, f"{report} {types[report]}, fact_no {types['fact_no']}"


def _sweep(rows: DataFrame, report: str, chunk_keys: int) -> DataFrame:
    """Facts taken in groups too large for one task: chunks of ``chunk_keys`` keys in fact order, one after the other.

    A chunk first drops the facts that share a key with one taken before, then is walked by one task; the chunks of all groups with the same number
    are worked on together. So the steps are the chunks of the largest group, however long its chains are.
    """
    spark = rows.sparkSession
    facts = rows.groupBy("component", report, "fact_no").agg(F.count(F.lit(1)).alias("n"))
    by = ["fact_no", report]
    summed = scan(order_chunks(facts, ["component"], by), ["component"], by, sums={"upto": F.col("n")})
    number = summed.select(report, "fact_no", F.floor((F.col("upto") - 1) / chunk_keys).cast("int").alias("chunk"))
    dealt = stage(rows.join(number, [report, "fact_no"]), "sweep", "chunk")
    walk, result = _walk(report, dict(rows.dtypes))
    last = dealt.agg(F.max("chunk")).first()[0]
    won_path, key_path = new_path(spark, "won"), new_path(spark, "taken")
    won_schema, key_schema = rows.select(report, "fact_no").schema, rows.select(report, "key").schema
    spark.createDataFrame([], won_schema).write.parquet(won_path)
    spark.createDataFrame([], key_schema).write.parquet(key_path)
    for chunk in range(-1 if last is None else last + 1):
        part = dealt.where(F.col("chunk") == chunk)
        if chunk:
            taken = spark.read.schema(key_schema).parquet(key_path)
            lost = part.join(taken, [report, "key"], "left_semi").select(report, "fact_no").distinct()
            part = part.join(lost, [report, "fact_no"], "left_anti")
        won = stage(part.select("component", report, "fact_no", "key").groupBy("component").applyInPandas(walk, result), "won")
        won.write.mode("append").parquet(won_path)
        if chunk < last:
            part.join(won, [report, "fact_no"], "left_semi").select(report, "key").write.mode("append").parquet(key_path)
    return spark.read.schema(won_schema).parquet(won_path)


def missing_facts(drafts: DataFrame, summary: DataFrame, report: str = "report_id", group_rows: int = 200_000) -> DataFrame:
    """Draft facts the summary lacks, each accepted fact hiding later ones that share a key with it.

    Drafts have (report, fact_no, text, citations), the summary (report, text, citations). A report of up to ``group_rows`` keys is walked by
    one task. A larger one is cut into groups of facts connected by keys, which don't influence each other: small groups take a task each, larger
    ones are swept in chunks of that size. Adds the subsection the fact belongs to. Runs several jobs.
    """
    # keys are only compared: 128 bits stand for each, so that the steps move no texts
    keys = F.transform(fact_keys(F.col("text"), F.col("citations")), lambda k: F.unhex(F.md5(k)))
    told = summary.select(report, F.explode(keys).alias("key")).distinct().withColumn("_told", F.lit(True))
    listed = drafts.select(report, "fact_no", F.explode_outer(keys).alias("key"))
    marked = attach(listed, told, [report, "key"])
    hidden = marked.where("_told").select(report, "fact_no").distinct().withColumn("_hidden", F.lit(True))
    # few rows share a fact, so its join needs no salts
    open_rows = stage(attach(listed, hidden, [report, "fact_no"], salts=1).where("_hidden is null").drop("_hidden"), "facts")
    kept = open_rows.where("key is null").select(report, "fact_no")
    open_rows = open_rows.where("key is not null")
    walk, result = _walk(report, dict(open_rows.dtypes))

    sizes = stage(open_rows.groupBy(report).agg(F.count(F.lit(1)).alias("n")), "sizes")
    if (sizes.agg(F.max("n")).first()[0] or 0) <= group_rows:
        small, large = open_rows, None
    else:
        counted = attach_counted(open_rows, sizes, [report], "n")
        small, large = counted.where(F.col("n") <= group_rows), stage(counted.where(F.col("n") > group_rows).drop("n"), "large")
    kept = kept.unionByName(small.groupBy(report).applyInPandas(walk, result))
    if large is not None:
        kept = kept.unionByName(_connected_facts(large, report, group_rows))
    return drafts.join(kept, [report, "fact_no"], "left_semi").withColumn("sub_title", classify_fact(F.col("text")))


def _connected_facts(rows: DataFrame, report: str, group_rows: int) -> DataFrame:
    """Accepted facts of large reports."""
    first = stage(rows.groupBy(report, "key").agg(F.min("fact_no").alias("first_no"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    # a hash stands for a fact: if two should share one, their groups are only walked together
    node = lambda c: F.xxhash64(report, c)
    edges = attach_counted(rows, first, [report, "key"], "n").where("fact_no <> first_no").select(
        node("fact_no").alias("a"), node("first_no").alias("b"))
    groups = connected_components(edges, "a", "b")
    placed = stage(rows.withColumn("node", node("fact_no")).join(groups, "node", "left").drop("node"), "facts")
    alone = placed.where("component is null").select(report, "fact_no").distinct()
    linked = placed.where("component is not null")
    sizes = stage(linked.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    counted = attach_counted(linked, sizes, ["component"], "n")
    walk, result = _walk(report, dict(rows.dtypes))
    small = counted.where(F.col("n") <= group_rows).drop("n")
    swept = _sweep(stage(counted.where(F.col("n") > group_rows).drop("n"), "large"), report, group_rows)
    return alone.unionByName(small.groupBy("component").applyInPandas(walk, result)).unionByName(swept)
