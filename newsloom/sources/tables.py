"""Indicator rows from text lines and from table cells (table_id, row, col, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DATE_RANGE
from ..functions.numbers import parse_value_change, rate_value
from ..functions.text import SPACE_CLASS, strip
from ..scale import attach, keep_first, keep_last, order_chunks, scan, scan_rows, top_n
from ..session import stage

# Default indicator and unit, header words, how far a value may follow its date,
# and the tokens that make a line a header.
RATE_NAME, RATE_UNIT = "Ключевая ставка", "%"
NUMBER_SIGN, NAME_WORD, NAME_WORD_2 = "№", "Наименование", "показателя"
VALUE_DISTANCE = 80
HEADER_TOKEN = r"(?iu)\b(20\d{2}|Янв\.\s*20\d{2}|Фев\.\s*20\d{2})\b"
HEADER_LINES = 5
DASH = "—"


def _row(name: Column, period: Column, value: Column, change: Column, unit: Column) -> list[Column]:
    return [name.alias("indicator_name"), period.alias("period"), value.cast("double").alias("value"),
            change.cast("double").alias("change_pct"), unit.cast("string").alias("unit")]


def _rate_row(period: Column, value: Column, name: str) -> list[Column]:
    return _row(F.lit(name), period, value, F.lit(None), F.lit(RATE_UNIT))


def date_value_rows(lines: DataFrame, indicator: str = RATE_NAME) -> DataFrame:
    """One row per line (doc_id, line_no, line) with a date or date range and a rate after it."""
    line = strip(F.col("line"))
    found = lines.withColumns({"_l": line, "_p": F.regexp_extract(line, DATE_RANGE, 1)}).where("_p <> ''")
    after = F.regexp_extract(F.col("_l"), r"(?s)" + DATE_RANGE + r"(.*)$", 2)
    cells = F.split(F.col("_l"), r"\s{2,}|\t|\|", -1)
    value = F.coalesce(rate_value(after), rate_value(F.get(cells, F.lit(1))))
    return found.select("doc_id", "line_no", *_rate_row(strip(F.col("_p")), value, indicator)).where("value is not null")


def date_value_pairs(texts: DataFrame, indicator: str = RATE_NAME) -> DataFrame:
    """One row per date in a whole text (doc_id, text) that has a rate within the next 80 characters."""
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), rf"{SPACE_CLASS}+", " ")
    pattern = DATE_RANGE + rf"(?=(.{{0,{VALUE_DISTANCE}}}))"

    def pairs(t: Column) -> Column:
        return F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("p"),
                            F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("v"))

    rows = texts.select("doc_id", F.posexplode(F.transform(F.array(flat), pairs)[0]).alias("pos", "x"))
    return rows.select("doc_id", "pos", *_rate_row(strip(F.col("x.p")), rate_value(F.col("x.v")), indicator)).where("value is not null")


def date_value_table(texts: DataFrame, indicator: str = RATE_NAME) -> DataFrame:
    """Rows of both readings of each text, line by line first, one per document, name and period."""
    split = F.split("text", r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    lines = texts.select("doc_id", F.posexplode(split).alias("line_no", "line"))
    a = date_value_rows(lines, indicator).withColumn("_o", F.struct(F.lit(0).alias("a"), F.col("line_no").alias("b"))).drop("line_no")
    b = date_value_pairs(texts, indicator).withColumn("_o", F.struct(F.lit(1).alias("a"), F.col("pos").alias("b"))).drop("pos")
    return keep_first(a.unionByName(b), ["doc_id", "indicator_name", "period"], ["_o"]).drop("_o")


def wide_rows_from_text(lines: DataFrame) -> DataFrame:
    """Long rows of text tables: name and one value per period, columns split on tabs or several spaces.

    The periods are the year tokens of the first of the first five non-blank lines that has any; columns
    beyond them are named by their number.
    """
    full = lines.withColumn("_l", strip(F.col("line"))).where("_l <> ''")
    first = _first_lines(full)
    head = first.where(F.size("periods") > 0).groupBy("doc_id").agg(F.min_by("periods", "line_no").alias("periods"))
    parts = F.split(F.col("_l"), r"\s{2,}|\t", -1)
    rows = full.join(head, "doc_id", "left").withColumn("parts", parts).where(
        (F.size("parts") >= 2) & ~F.col("_l").rlike(r"(?iu)^№?\s*$") & ~F.col("_l").rlike(r"(?iu)^Наименование"))
    rows = rows.withColumn("name", strip(F.col("parts")[0])).where("name <> ''").where(~F.col("name").rlike(r"^\d+$"))
    cells = rows.select("doc_id", "line_no", "name", "periods", F.posexplode(F.slice("parts", 2, F.size("parts"))).alias("i", "cell"))
    cells = cells.withColumn("c", parse_value_change(F.col("cell"))).where("c.value is not null")
    period = F.coalesce(F.get("periods", F.col("i")), F.col("i").cast("string"))
    named = cells.select("doc_id", "line_no", "i", *_row(F.col("name"), period, F.col("c.value"), F.col("c.change_pct"), F.lit(None)))
    return named


def _first_lines(full: DataFrame) -> DataFrame:
    tokens = F.regexp_extract_all(F.col("_l"), F.lit(HEADER_TOKEN), F.lit(1))
    return top_n(full.select("doc_id", "line_no", tokens.alias("periods")), ["doc_id"], [F.col("line_no")], HEADER_LINES)


# --- cell tables -------------------------------------------------------------------------------------

def _clean(cells: DataFrame) -> DataFrame:
    return cells.withColumn("text", strip(F.coalesce("text", F.lit(""))))


def _looks_like_date(c: Column) -> Column:
    return (F.char_length(c) >= 10) & c.rlike(DATE_RANGE)


def table_date_values(cells: DataFrame) -> DataFrame:
    """(table_id, row, …): rows whose first cell is a date and a later cell holds a rate."""
    c = _clean(cells)
    value = rate_value(F.col("text"))
    rows = c.groupBy("table_id", "row").agg(
        F.max(F.when(F.col("col") == 0, F.col("text"))).alias("first"),
        F.min_by(value, F.when((F.col("col") > 0) & value.isNotNull(), F.col("col"))).alias("v"))
    ok = _looks_like_date(F.col("first")) & ~F.contains(F.col("first"), F.lit(NAME_WORD)) & F.col("v").isNotNull()
    return rows.where(ok).select("table_id", "row", *_rate_row(F.col("first"), F.col("v"), RATE_NAME))


def forward_fill_parent(rows: DataFrame, key: str, order: list[str], name: str = "name") -> DataFrame:
    """Add parent_name: the last name up to this row that is not a child (children start with a dash)."""
    parent = F.when(~F.startswith(F.col(name), F.lit(DASH)), F.col(name))
    return scan_rows(rows, [key], order, fills={"parent_name": parent})


def unpivot_matrix(cells: DataFrame) -> DataFrame:
    """Indicator × period tables to long rows; child rows are prefixed with the last parent that had values.

    The name column is the first one, or the second when the first header is a number sign next to a header
    that speaks of names. Periods are the non-blank headers after it, counted from left to right.
    """
    c = stage(_clean(cells), "cells")
    head = c.where("row = 0")
    names = head.groupBy("table_id").agg(
        F.max(F.when(F.col("col") == 0, F.col("text"))).alias("h0"), F.max(F.when(F.col("col") == 1, F.col("text"))).alias("h1"))
    second = (F.col("h0") == NUMBER_SIGN) & (F.col("h1") != "") & (
        F.contains("h1", F.lit(NAME_WORD)) | F.contains(F.lower("h1"), F.lit(NAME_WORD_2)))
    names = stage(names.select("table_id", F.when(F.coalesce(second, F.lit(False)), 1).otherwise(0).alias("name_col")), "names")
    periods = attach(head, names, ["table_id"], "inner").where((F.col("col") > F.col("name_col")) & (F.col("text") != ""))
    numbered = scan(order_chunks(periods.select("table_id", "col", "text"), ["table_id"], ["col"]), ["table_id"], ["col"],
                    rank="slot").select("table_id", F.col("slot").alias("slot"), F.col("text").alias("period"))
    body = attach(c.where("row > 0"), names, ["table_id"], "inner")
    name = body.where(F.col("col") == F.col("name_col")).select("table_id", "row", F.col("text").alias("name"))
    name = name.where((F.col("name") != "") & (F.col("name") != NUMBER_SIGN) & ~F.col("name").rlike(rf"(?iu)^{NAME_WORD}"))
    values = body.where(F.col("col") > F.col("name_col")).select(
        "table_id", "row", (F.col("col") - F.col("name_col")).cast("long").alias("slot"), parse_value_change(F.col("text")).alias("c"))
    values = attach(values.where("c.value is not null"), numbered, ["table_id", "slot"], "inner")
    # of equal period headers the last one with a value counts
    values = stage(keep_last(values, ["table_id", "row", "period"], ["slot"]), "values")
    filled = forward_fill_parent(name.join(values.select("table_id", "row").distinct(), ["table_id", "row"], "left_semi"),
                                 "table_id", ["row"])
    child = F.regexp_replace(F.col("name"), rf"^{DASH}+", "")
    is_child = F.startswith(F.col("name"), F.lit(DASH))
    label = F.when(~is_child, F.col("name")).otherwise(
        F.concat(F.coalesce(F.concat(F.col("parent_name"), F.lit(f" {DASH} ")), F.lit("")), strip(child)))
    return values.join(filled, ["table_id", "row"]).select(
        "table_id", "row", "slot", *_row(label, F.col("period"), F.col("c.value"), F.col("c.change_pct"), F.lit(None)))


def table_fallback(cells: DataFrame) -> DataFrame:
    """First column as name, non-blank headers of the other columns as periods, counted from left to right."""
    c = _clean(cells)
    headers = c.where("row = 0 and col > 0 and text <> ''").select("table_id", "col", "text")
    numbered = scan(order_chunks(headers, ["table_id"], ["col"]), ["table_id"], ["col"], rank="slot").select(
        "table_id", "slot", F.col("text").alias("period"))
    name = c.where("row > 0 and col = 0").select("table_id", "row", F.col("text").alias("name")).where(
        (F.col("name") != "") & (F.col("name") != NUMBER_SIGN) & ~F.contains("name", F.lit(NAME_WORD)))
    values = c.where("row > 0 and col > 0").select(
        "table_id", "row", F.col("col").cast("long").alias("slot"), parse_value_change(F.col("text")).alias("c")).where("c.value is not null")
    joined = attach(values.join(name, ["table_id", "row"]), numbered, ["table_id", "slot"])
    period = F.coalesce("period", (F.col("slot") - 1).cast("string"))
    joined = keep_last(joined.withColumn("period", period), ["table_id", "row", "period"], ["slot"])
    return joined.select("table_id", "row", "slot", *_row(F.col("name"), F.col("period"), F.col("c.value"), F.col("c.change_pct"), F.lit(None)))


def classify_table(cells: DataFrame) -> DataFrame:
    """Rows of each table with its kind: date values first, then matrix, then plain headers.

    The plain rows of a document are left out when any of its tables gave rows of the first two kinds.
    Cells carry doc_id.
    """
    sizes = cells.groupBy("table_id").agg(F.max("row").alias("_last"), F.first("doc_id").alias("doc_id")).where("_last >= 1")
    # each reading works on what the one before left over, so every step is written out once
    usable = stage(_clean(cells).join(sizes.select("table_id", "_last"), "table_id").drop("_last"), "cells")
    order = ["table_id", "row", "slot", "indicator_name", "period", "value", "change_pct", "unit"]
    dated = table_date_values(usable).withColumn("slot", F.lit(0).cast("long"))
    flat = stage(dated.select(*order, F.lit("date_value").alias("kind")), "dated")
    left = stage(usable.join(flat.select("table_id").distinct(), "table_id", "left_anti"), "cells")
    matrix = stage(unpivot_matrix(left).select(*order, F.lit("matrix").alias("kind")), "matrix")
    plain = table_fallback(left.join(matrix.select("table_id").distinct(), "table_id", "left_anti"))
    docs = usable.groupBy("table_id").agg(F.first("doc_id").alias("doc_id"))
    found = attach(flat.unionByName(matrix), docs, ["table_id"], "inner")
    rest = attach(plain.select(*order, F.lit("headers").alias("kind")), docs, ["table_id"], "inner")
    return found.unionByName(rest.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*found.columns))
