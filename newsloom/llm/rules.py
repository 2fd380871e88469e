"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides.

Every rule looks at a few figures of a text and votes good (1), bad (0) or abstains (-1). Documents are counted by their pattern of votes
(at most 3^rules patterns, whatever the number of documents), and EM runs on those counts: for each class of documents it
estimates how often a rule votes good, bad or not at all. A document is kept when its posterior probability of being good is
at least one half; no rule alone can reject it, save the fixed base limits.

EM takes rules as independent within a class, so figures that move together share one rule: repeated lines, windows and neighbours are
one, and each of the others looks at a trait of its own. Junk shows in several traits at once (foreign marks at words, runs of marks,
few letters, shouting, lines without an end), which is what tells the classes apart without a label.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import BASES, Rolling, mix64

SYMBOLS = "#*$%&|<>"
REPEAT_WIDTH = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_digits",
           "n_wide", "n_plain", "n_runs", "n_adjacent", "n_ends"]
PLAIN = re.compile(rb"[\"'(\x80-\xff]*[A-Za-z\x80-\xff]+(?:['\-][A-Za-z\x80-\xff]+)*[\"')]*[.,;:!?]?[\"')]*")
RUN = re.compile(rb"([!-/:-@\[-`{-~])\1")
#: bytes that end a line of prose; the last one ends some wide quotation marks and dots
ENDS = tuple(b".!?:;\"\xa6\x9d")


class WordMarks(dict):
    """word → 1 if it is letters and ordinary punctuation, 2 if it has a mark twice in a row; remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        n = self[word] = (PLAIN.fullmatch(word) is not None) + 2 * (RUN.search(word) is not None)
        return n


def text_figures(text: str | None, marks: WordMarks | None = None) -> tuple[int, ...]:
    """The figures of one text, in the order of FIGURES."""
    text, marks = text or "", WordMarks() if marks is None else marks
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blanks = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    codes = np.frombuffer(raw, np.uint8)
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    letters = upper + int(((codes >= 97) & (codes <= 122)).sum())
    digits = int(((codes >= 48) & (codes <= 57)).sum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.uint64)
    marked = np.fromiter(map(marks.__getitem__, words), np.uint8, n)
    ended = sum(line.rstrip()[-1] in ENDS for line in lines)
    return (n, len(text) - blanks, sum(raw.count(c.encode()) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(ids),
            len(lines), upper, letters, len(numbers), digits, len(text) - int((codes < 128).sum()), int((marked & 1).sum()), int((marked >> 1).sum()),
            int((ids[1:] == ids[:-1]).sum()), ended)


def repeat_words(ids: np.ndarray, width: int = REPEAT_WIDTH) -> int:
    """Words inside windows that are found twice or more in the text, the first place included."""
    windows = Rolling(width, BASES[0])(mix64(ids))
    if not len(windows):
        return 0
    _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
    steps = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(count[back] > 1)
    steps[starts] += 1
    steps[starts + width] -= 1
    return int((np.cumsum(steps) > 0).sum())


def figures(docs: DataFrame) -> DataFrame:
    """(_id, _th, figures …) of every row."""
    def run(batches):
        marks = WordMarks()
        for batch in batches:
            rows = np.array([text_figures(t, marks) for t in batch["text"].to_pylist()], np.int64).reshape(-1, len(FIGURES))
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_th"], *[pa.array(rows[:, i]) for i in range(len(FIGURES))]],
                                             names=["_id", "_th", *FIGURES])

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), "text").mapInArrow(
        run, "_id long, _th long, " + ", ".join(f"{f} long" for f in FIGURES))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1).cast("int")


def default_rules() -> dict[str, Column]:
    """name → vote over the figures; shares are compared by whole numbers."""
    c = F.col
    some = c("n_words") >= 10

    def most(part: str, whole: Column, good: int, bad: int) -> Column:
        """Good from ``good`` percent of the whole on, bad below ``bad`` percent."""
        return _vote(some & (100 * c(part) >= good * whole), some & (100 * c(part) < bad * whole))

    def few(part: str, whole: Column, good: int, bad: int) -> Column:
        return _vote(some & (100 * c(part) <= good * whole), some & (100 * c(part) > bad * whole))

    words, chars = c("n_words"), c("word_chars")
    repeated = (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * words) | (100 * c("n_adjacent") > 10 * words) | (100 * c("n_dup_lines") > 30 * c("n_lines"))
    fresh = (100 * c("n_repeat_words") <= 5 * words) & (100 * c("n_adjacent") <= 2 * words) & (100 * c("n_dup_lines") <= 10 * c("n_lines"))
    return {
        "length": _vote(words >= 50, words < MIN_WORDS),
        "word_length": _vote(some & chars.between(3 * words, 10 * words), some & ~chars.between(2 * words, 14 * words)),
        "symbols": few("n_symbols", words, 2, 20),
        "repetition": _vote(some & fresh, some & repeated),
        "upper": _vote(some & (100 * c("n_upper") <= 15 * c("n_letters")), (c("n_letters") >= 20) & (100 * c("n_upper") > 40 * c("n_letters"))),
        "variety": most("n_distinct", F.least(words, F.lit(1000)), 20, 10),
        "letters": _vote(some & (100 * (c("n_letters") + c("n_wide")) >= 90 * chars), some & (100 * (c("n_letters") + c("n_wide")) < 80 * chars)),
        "plain_words": most("n_plain", words, 85, 65),
        "runs": few("n_runs", words, 2, 10),
        "line_ends": most("n_ends", c("n_lines"), 60, 30),
    }


def fit_rules(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good documents, table[class, rule, vote + 1], posterior of each pattern) by EM from weak starting accuracies.

    Counts carry one pseudo-count per class, rule and vote, so unseen votes and empty tables are defined; it starts from rules that are right
    in 80 % of their votes, which fixes which of the two classes is the good one.
    """
    rules = patterns.shape[1]
    share = 0.7
    table = np.tile(np.array([[0.4, 0.4, 0.2], [0.4, 0.1, 0.5]])[:, None, :], (1, rules, 1))  # votes: none, bad, good
    table[0, :, :] = [0.4, 0.48, 0.12]
    table[1, :, :] = [0.4, 0.12, 0.48]
    seen = np.eye(3)[patterns + 1]  # pattern, rule, vote
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        logs = np.einsum("prv,crv->pc", seen, np.log(table)) + np.log([1 - share, share])
        fresh = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        moved = np.abs(fresh - posterior).max(initial=0)
        posterior = fresh
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        table = np.einsum("cp,prv->crv", weight, seen) + np.array([[[1, 4, 1]], [[1, 1, 4]]]) / 6
        table /= table.sum(axis=2, keepdims=True)
        share = (weight[1].sum() + 0.7) / (counts.sum() + 1)
        if moved < 1e-9:
            break
    return share, table, posterior


def judge_quality(docs: DataFrame, rules: dict[str, Column] | None = None, at_least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, _th, figures, base_failed, posterior, kept.

    Null and empty texts have no words and fail the base limit. Repeated rows are counted and judged one by one; null ids are judged like others;
    other columns are ignored, whatever their names; an empty table gives an empty result. A posterior of exactly ``at_least`` keeps.
    Runs two jobs: the figures are staged, their vote patterns (at most 3^rules) are counted and collected.
    """
    rules = rules or default_rules()
    spark = docs.sparkSession
    voted = stage(figures(docs), "figures").withColumns({f"v_{name}": vote for name, vote in rules.items()})
    votes = [f"v_{name}" for name in rules]
    counted = voted.groupBy(*votes).count().collect()
    patterns = np.array([[r[v] for v in votes] for r in counted], np.int64).reshape(-1, len(votes))
    _, _, posterior = fit_rules(patterns, np.array([r["count"] for r in counted], float))
    known = spark.createDataFrame([(*map(int, p), float(x)) for p, x in zip(patterns, posterior)],
                                  ", ".join(f"{v} int" for v in votes) + ", posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = voted.join(F.broadcast(known), votes)  # bounded by 3^rules rows
    return out.select(F.col("_id").alias("doc_id"), "_th", *FIGURES, failed.alias("base_failed"), "posterior",
                      (~failed & (F.col("posterior") >= at_least)).alias("kept"))
