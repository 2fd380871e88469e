"""Text lines of items and clusters, and their packing into character budgets."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..scale import CHUNK, IDENTITY, order_chunks, rejoin, row_identity, scan, top_n

# Room kept for the header of a batch, and the options of the single-text selection.
NEWS_RESERVE = 280
POSTS_RESERVE = 420
TEXT_BUDGET = 72_000
SELECT_LIMITS = [800, 500, 350, 200, 120, 80]
SELECT_FALLBACK = 60
CUT_NOTE = "\n\n[... обрезано по лимиту контекста ...]"
NO_TITLE = "Без заголовка"


def day_text(ts: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.coalesce(F.date_format(ts, pattern), F.lit("—"))


def linked(title: Column, url: Column) -> Column:
    u = strip(F.coalesce(url, F.lit("")))
    return F.when(u != "", F.concat(F.lit("["), title, F.lit("]("), u, F.lit(")"))).otherwise(title)


def news_text(snippet_chars: int, label: Column | None = None) -> Column:
    """Line of one item: date and linked title, plus a second line with the start of its snippet."""
    title = strip(F.replace(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(NO_TITLE)), F.lit("\n"), F.lit(" ")))
    prefix = F.coalesce(F.concat(F.lit("["), label, F.lit("] ")), F.lit("")) if label is not None else F.lit("")
    head = F.concat(F.lit("- "), prefix, day_text(F.col("published_at")), F.lit(" | "), linked(title, F.col("url")))
    if snippet_chars <= 0:
        return head
    sn = F.col("snippet")
    cut = F.concat(F.substring(sn, 1, snippet_chars),
                   F.when(F.char_length(sn) > snippet_chars, F.lit("…")).otherwise(F.lit("")))
    return F.concat(head, F.when(F.coalesce(sn, F.lit("")) != "", F.concat(F.lit("\n  "), cut)).otherwise(F.lit("")))


def news_lines(items: DataFrame, snippet_chars: int = 400) -> DataFrame:
    """Add ``line``; items may carry ``entity_label`` (the names put in front of the date)."""
    label = F.nullif(F.col("entity_label"), F.lit("")) if "entity_label" in items.columns else None
    return items.withColumn("line", news_text(snippet_chars, label))


def entity_label(competitor_name: Column, mentioned: Column) -> Column:
    """Name of the item's own entity, else the mentioned names joined by commas."""
    return F.coalesce(F.nullif(competitor_name, F.lit("")), F.nullif(F.array_join(mentioned, ", "), F.lit("")))


def cluster_lines(members: DataFrame, threshold: int = 3) -> DataFrame:
    """(primary_id, position, line) from ``cluster_lookup`` rows: heading, primary, related items."""
    title = F.coalesce("title", F.lit(NO_TITLE))
    what = F.when(F.col("position") == 0, F.lit("  Главная: [")).otherwise(F.lit("  Похожая: ["))
    line = F.concat(what, day_text(F.col("published_at"), "yyyy-MM-dd HH:mm"), F.lit("] "), linked(title, F.col("url")))
    body = members.select("primary_id", "position", line.alias("line"))
    number = "cluster_no" if "cluster_no" in members.columns else "primary_id"
    heads = members.where("position = 0").select(
        "primary_id", F.lit(-1).alias("position"),
        F.concat(F.lit("### Кластер "), F.col(number).cast("string"),
                 F.lit(f", порог simhash: {threshold}")).alias("line"))
    return heads.unionByName(body)


def number_text(c: Column) -> Column:
    """Shortest plain decimal text of a double, with at least one decimal."""
    s = F.regexp_replace(F.format_string("%.10f", c), "0+$", "")
    return F.when(F.endswith(s, F.lit(".")), F.concat(s, F.lit("0"))).otherwise(s)


def indicator_lines(daily: DataFrame, parsed: DataFrame) -> DataFrame:
    """(block, sort keys, line): daily values, then parsed indicators with their unit."""
    d = daily.select(F.lit("daily").alias("block"), F.col("period_date").cast("string").alias("sort_a"),
                     F.lit("").alias("sort_b"),
                     F.concat(F.lit("  "), F.col("period_date").cast("string"), F.lit(","), number_text(F.col("value")))
                     .alias("line"))
    p = parsed.select(F.lit("parsed").alias("block"), F.col("indicator_name").alias("sort_a"),
                      F.col("period").alias("sort_b"),
                      F.concat(F.lit("  "), F.col("indicator_name"), F.lit(","), F.col("period"), F.lit(","),
                               number_text(F.col("value")), F.coalesce("unit", F.lit(""))).alias("line"))
    return d.unionByName(p)


# --- greedy packing ----------------------------------------------------------------------------------
#
# Packing walks one ordered group: an item opens a new batch when it no longer fits the open one. To walk
# the chunks of a group in parallel, each chunk first tells how it would answer every possible fill of the
# batch that is open when it starts; those answers are few, because only the first item that no longer fits
# matters and a batch holds few items. The answers are chained per group, then every chunk numbers its items.

def _starts(w: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a batch opened at each item: chars in the last batch at the end, and batches opened on the way."""
    total = np.concatenate([[0], np.cumsum(w)])
    n = len(w)
    nxt = np.maximum(np.searchsorted(total[1:], total[:-1] + cap, side="right"), np.arange(1, n + 1))
    fill, opened = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for s in range(n - 1, -1, -1):
        if nxt[s] >= n:
            fill[s] = total[n] - total[s]
        else:
            fill[s], opened[s] = fill[nxt[s]], opened[nxt[s]] + 1
    return total, fill, opened


def _answers(cap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        total, fill, opened = _starts(pdf["w"].to_numpy(np.int64), cap)
        reach = min(int(np.searchsorted(total[1:], cap, side="right")) + 1, len(fill))
        return pd.DataFrame([{
            "grp": pdf["grp"].iloc[0], "chunk": pdf["chunk"].iloc[0], "total": int(total[-1]),
            "upto": total[1:reach + 1].tolist(), "fill": fill[:reach].tolist(), "opened": opened[:reach].tolist()}])

    return run


def _chain(cap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        open_chars, batch, rows = 0, -1, []
        for r in pdf.sort_values("chunk").itertuples():
            rows.append((r.grp, r.chunk, open_chars, batch))
            first = int(np.searchsorted(np.asarray(r.upto), cap - open_chars, side="right")) if batch >= 0 else 0
            if batch >= 0 and first >= len(r.fill):
                open_chars += r.total
            else:
                open_chars, batch = int(r.fill[first]), batch + 1 + int(r.opened[first])
        return pd.DataFrame(rows, columns=["grp", "chunk", "open_chars", "batch"])

    return run


def _number(cap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        chars, batch, out = int(pdf["open_chars"].iloc[0]), int(pdf["batch"].iloc[0]), []
        for w in pdf["w"]:
            if batch < 0 or chars + w > cap:
                chars, batch = 0, batch + 1
            chars += w
            out.append(batch)
        return pd.DataFrame({"grp": pdf["grp"], "pos": pdf["pos"], "batch_no": out})

    return run


def char_batches(rows: DataFrame, group: str, order: list[str], length: Column, max_chars: int = TEXT_BUDGET,
                 reserve: int = NEWS_RESERVE, newest_first: bool = True) -> DataFrame:
    """Add batch_no (from 0) per group: lines joined by newlines plus ``reserve`` fit into ``max_chars``.

    ``order`` is (timestamp, id), undated rows count as oldest; an item too long for any batch gets its own.
    ``group`` must be a string column; null counts as ''. Every row comes back once, whatever repeats: ids, times or whole rows.
    """
    ts, row_id = order
    stamp = F.coalesce(F.unix_micros(ts), F.lit(-(2 ** 62)))
    # only group, order, width and the rows' identities are staged; rows of equal or null ids stay apart by their content
    sized = rows.select(F.coalesce(F.col(group), F.lit("")).alias("_grp"), (-stamp if newest_first else stamp).alias("_at"),
                        F.col(row_id).alias("_rid"), (length + 1).cast("long").alias("_w"), *row_identity(rows))
    by = ["_at", "_rid", *IDENTITY]
    placed = scan(order_chunks(sized, ["_grp"], by), ["_grp"], by, rank="_pos")
    cap = max_chars - reserve + 1
    narrow = placed.select(F.col("_grp").alias("grp"), F.col(CHUNK).alias("chunk"), F.col("_pos").alias("pos"), F.col("_w").alias("w"))
    answers = narrow.groupBy("grp", "chunk").applyInPandas(
        _answers(cap), "grp string, chunk int, total long, upto array<long>, fill array<long>, opened array<long>")
    entries = answers.groupBy("grp").applyInPandas(_chain(cap), "grp string, chunk int, open_chars long, batch long")
    numbered = narrow.join(entries, ["grp", "chunk"]).groupBy("grp", "chunk").applyInPandas(
        _number(cap), "grp string, pos long, batch_no long")
    found = placed.join(numbered, (F.col("_grp") == F.col("grp")) & (F.col("_pos") == F.col("pos"))).select(*IDENTITY, "batch_no")
    return rejoin(rows, found)


def batch_texts(batched: DataFrame, group: str, order: list[str], line: str = "line",
                newest_first: bool = True) -> DataFrame:
    """(group, batch_no, items, text): the joined lines of each batch, bounded by its character budget."""
    ts, row_id = order
    stamp = F.coalesce(F.unix_micros(ts), F.lit(-(2 ** 62)))
    rows = F.struct((-stamp if newest_first else stamp).alias("at"), F.col(row_id).alias("id"), F.col(line).alias("line"))
    out = batched.groupBy(group, "batch_no").agg(
        F.count(F.lit(1)).alias("items"), F.array_sort(F.collect_list(rows)).alias("r"))
    return out.select(group, "batch_no", "items", F.array_join(F.col("r.line"), "\n").alias("text"))


def _omitted_note(total: Column, shown: Column) -> Column:
    return F.concat(F.lit("Всего новостей в разделе: "), total.cast("string"), F.lit(". Ниже "), shown.cast("string"),
                    F.lit(" самых свежих (остальные опущены по лимиту контекста ИИ)."))


def budget_select(items: DataFrame, group: str, max_chars: int = TEXT_BUDGET, snippet_chars: int = 400) -> DataFrame:
    """One text per group: its newest items, with the longest snippets and the most items that fit.

    Returns (group, total, shown, snippet_chars, truncated, text). Only the newest 800 per group can be
    shown; ``total`` counts all of them.
    """
    snips = list(dict.fromkeys([snippet_chars, max(snippet_chars // 2, 180), 0]))
    totals = items.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    newest = top_n(items.select(group, "item_id", "title", "url", "snippet", "published_at"), [group],
                   [F.col("published_at").desc_nulls_last(), F.col("item_id")], max(SELECT_LIMITS))
    lined = newest.select(group, "rank", *[news_text(s).alias(f"t{i}") for i, s in enumerate(snips)])
    upto = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = lined.withColumns({f"w{i}": F.sum(F.char_length(f"t{i}") + 1).over(upto) for i in range(len(snips))})
    limits = [*SELECT_LIMITS, SELECT_FALLBACK]
    # running size at the row where each limit cuts the group
    sizes = sized.groupBy(group).agg(*[
        F.max(F.when(F.col("rank") <= limit, F.col(f"w{i}"))).alias(f"w{i}_{limit}")
        for i in range(len(snips)) for limit in limits])
    sizes = sizes.join(totals, group)
    total = F.col("total")
    options, choice = [], F.lit(None).cast("int")
    for i, s in enumerate(snips):
        options += [(i, s, limit) for limit in SELECT_LIMITS]
    fallback = (len(snips) - 1, 0, SELECT_FALLBACK)

    def shown(limit: int) -> Column:
        return F.least(total, F.lit(limit))

    def note(limit: int) -> Column:
        return F.when(total > shown(limit), F.concat(_omitted_note(total, shown(limit)), F.lit("\n\n"))).otherwise(F.lit(""))

    for no in range(len(options) - 1, -1, -1):
        i, _, limit = options[no]
        fits = F.char_length(note(limit)) + F.col(f"w{i}_{limit}") - 1 <= max_chars
        choice = F.when(fits, F.lit(no)).otherwise(choice)
    picked = sizes.select(group, "total", F.coalesce(choice, F.lit(len(options))).alias("_o"))
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"), F.lit(limit).alias("n"))
                      for i, s, limit in [*options, fallback]])
    picked = picked.withColumn("_c", F.get(table, F.col("_o")))
    body = lined.join(picked, group).where(F.col("rank") <= F.col("_c.n"))
    text = F.get(F.array(*[F.col(f"t{i}") for i in range(len(snips))]), F.col("_c.i"))
    joined = body.groupBy(group).agg(
        F.first("total").alias("total"), F.first("_c").alias("_c"), F.first("_o").alias("_o"),
        F.count(F.lit(1)).alias("shown"), F.array_sort(F.collect_list(F.struct("rank", text.alias("line")))).alias("l"))
    omitted = F.when(F.col("total") > F.col("shown"), F.concat(_omitted_note(F.col("total"), F.col("shown")), F.lit("\n\n"))
                     ).otherwise(F.lit(""))
    whole = F.concat(omitted, F.array_join(F.col("l.line"), "\n"))
    too_long = F.char_length(whole) > max_chars
    return joined.select(
        group, "total", "shown", F.col("_c.s").alias("snippet_chars"), too_long.alias("truncated"),
        F.when(too_long, F.concat(F.substring(whole, 1, max_chars - 40), F.lit(CUT_NOTE))).otherwise(whole).alias("text"))
