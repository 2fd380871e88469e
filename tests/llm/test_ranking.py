"""Ranked lexical search against brute force over all documents."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from newsloom.llm import ranking

SCHEMA = "doc_id long, text string, lang string, source string, rank int, score string, terms string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, top):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_all, l_all = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, ts in wanted.items():
        scored = []
        for i, c, n in docs:
            m = 50 + (50 * n * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=lambda x: (str(x[0]), x[1]))


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["é", "ÜBER", "naïve", "x1"]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randrange(1, 120))) for _ in range(300)]
    texts += [None, "", " \n\t-", "W1,w2;W3_w4\0w5", " ".join(rng.choices(words, k=30_000)), texts[0], texts[0], texts[1].upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (None, texts[2]), (None, None), (7, "w9 w9 other")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(25)]
    items += [(30, " ".join(f"w{i}" for i in range(150))), (31, None), (32, ""), (33, "unknown words only"), (2, "w200 w201"), (None, "w7 w8"), (34, "w0")]
    return rows, items


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in rows], SCHEMA).repartition(parts)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=lambda x: (str(x[0]), x[1]))


@pytest.mark.parametrize("parts, top, block_pairs, first", [(3, 10, 200_000, 10**6), (7, 3, 60, 1), (1, 50, 1_000, 100)])
def test_ranking_equals_brute_force(spark, monkeypatch, parts, top, block_pairs, first):
    rows, items = corpus()
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    df = ranking.rank_documents(frame(spark, rows, parts), table, top=top, block_pairs=block_pairs, first_docs=first)
    assert got(df) == brute(rows, items, top)


def test_chunks_of_few_documents_and_masks_that_are_never_evaluated(spark):
    """Chunk logic without Spark: several index rows, chunks of 40 documents."""
    import numpy as np
    import pyarrow as pa

    rows, items = corpus()
    vocabulary = sorted({t for _, x in items for t in terms(x)})

    class Words:
        value = {**{t.encode(): i for i, t in enumerate(vocabulary)}, b"\0": -2}

    def batches():
        for lo in range(0, len(rows), 40):
            part = rows[lo:lo + 40]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([(t or "").encode() for _, t in part])], names=["doc_id", "text"])

    index = [r for b in batches() for out in ranking._indexer(Words)([b]) for r in out.to_pylist()]
    assert len(index) == -(-len(rows) // 40)
    docs = [c for c in (Counter(terms(t)) for _, t in rows) if c]
    df = Counter(t for c in docs for t in c)
    n_all, l_all = len(docs), sum(sum(c.values()) for c in docs)
    weights = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) for t in vocabulary])
    evaluated = []
    original = ranking.Best.add
    ranking.Best.add = lambda self, s, *a: (evaluated.append(len(s)), original(self, s, *a))[1]
    try:
        wanted = np.array(sorted(vocabulary.index(t) for t in set(terms(items[3][1]))))
        best = ranking.Best(5, 0)
        for r in index:
            ranking.Chunk([r], weights, n_all, l_all).search(wanted, best)
        whole = ranking.Best(5, 0)
        ranking.Chunk(index, weights, n_all, l_all).search(wanted, whole)
    finally:
        ranking.Best.add = original
    expected = [(r[3], r[2]) for r in brute(rows, [items[3]], 5)]
    for b in (best, whole):
        assert [(int(s), None if z else int(i)) for s, i, z in zip(b.scores, b.ids, b.null)] == expected
    assert sum(evaluated) < len(rows)  # bounds left most documents without a score


def test_empty_tables(spark):
    rows, items = corpus()
    none = spark.createDataFrame([], "item_id long, text string")
    assert got(ranking.rank_documents(frame(spark, rows), none)) == []
    some = spark.createDataFrame(items, "item_id long, text string")
    assert got(ranking.rank_documents(frame(spark, []), some)) == []
    assert got(ranking.rank_documents(frame(spark, [(1, None), (2, "")]), some)) == []
