"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the pieces that end at each character; dynamic programming carries the best score and its number of
pieces, without keeping the pieces. The rules are those of the public unigram tokenizers: blanks become ``▁``, a ``▁``
is put before the text if it has none, each ``▁`` starts a part of its own; of equal scores the piece that starts
first wins; a character that is no piece costs the lowest score less ten and counts as its UTF-8 bytes.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: the model file is a parameter; this is where this machine has it
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 200_000
REMEMBERED_CHARS = 64


def vocabulary_of(model: str = MODEL) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece model file; a fixed size, read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class PieceCounter:
    """Pieces of the best segmentation; counts of short parts are remembered, for a bounded number of them."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def part(self, text: str) -> int:
        n, unknown = len(text), self.unknown
        best, count, single = [0.0] + [-math.inf] * n, [0] * (n + 1), bytearray(n + 1)
        done = 0  # ends up to here are settled
        for last, (length, value) in self.automaton.iter(text):
            while done < last:
                done += 1
                if not single[done] and best[done - 1] + unknown > best[done]:
                    best[done] = best[done - 1] + unknown
                    count[done] = count[done - 1] + len(text[done - 1].encode("utf-8", "surrogatepass"))
            # matches of one end come longest first, so the piece that starts first keeps a tie
            total = best[last + 1 - length] + value
            if total > best[last + 1]:
                best[last + 1], count[last + 1] = total, count[last + 1 - length] + 1
            if length == 1:
                single[last + 1] = 1
        while done < n:
            done += 1
            if not single[done] and best[done - 1] + unknown > best[done]:
                best[done] = best[done - 1] + unknown
                count[done] = count[done - 1] + len(text[done - 1].encode("utf-8", "surrogatepass"))
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        parts = text.split(SPACE)
        if not text.startswith(SPACE):
            parts.insert(0, "")
        total, known = 0, self.known
        for p in parts[1:]:
            n = known.get(p)
            if n is None:
                n = self.part(SPACE + p)
                if len(p) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = n
            total += n
        return total


def count_tokens(docs: DataFrame, model: str = MODEL, vocabulary: list[tuple[str, float]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, _th, n_tokens.

    Null and empty texts have no tokens. Repeated rows and null ids are counted like others; other columns are ignored; an empty table gives an empty
    result. ``vocabulary`` overrides the model file; it is of fixed size and travels with the tasks.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary or vocabulary_of(model))

    def run(batches):
        counter = PieceCounter(pieces.value)
        for batch in batches:
            n = [counter.text(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_th"], pa.array(n, pa.int64())], names=["doc_id", "_th", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), "text")
    return rows.mapInArrow(run, "doc_id long, _th long, n_tokens long")
