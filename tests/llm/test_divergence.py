"""Source divergence audit against brute force, with levels of several lengths."""

import random
import re
from collections import Counter, defaultdict

import pytest

from newsloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, rank int, value string, block string, n int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    docs = [(l or "", s or "", Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))) for t, l, s in rows]
    df, use, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, c in docs:
        sources[lang].add(source)
        df[lang].update(c.keys())
        use[lang, source].update(c)
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        total = {s: sum(use[lang, s][t] for t in kept) for s in names}
        p = {s: {t: 1 + 10**9 * (use[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in names}
        q = {t: 1 + 10**9 * (sum(use[lang, s][t] for s in names) + 1) // (sum(total.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in names:
            pairs = sorted((-sum(f(p[s][t], p[h][t]) for t in kept), h) for h in names if h != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if use[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "pair", h, -v, i + 1) for i, (v, h) in enumerate(pairs)]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms)]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("pre", "prefix", "p", "über", "ü", "longer") for b in "abcdefghijkl"] + ["Pre", "x" * 300, "y" * 5000, "x" * 301, "ab中文"]
    rows = []
    for _ in range(400):
        some = rng.sample(words, 40)
        rows.append((" ".join(rng.choices(some, k=rng.randrange(1, 60))) + f" only{chr(97 + rng.randrange(26))}{rng.randrange(9)}",
                     rng.choice(["en", "en", "en", "de", None]), rng.choice(["hot", "hot", "a", "b", None, "Ω"])))
    rows += [(None, "en", "bare"), ("", "fr", "one"), (" 12 34 ", "fr", "two"), ("alone", "xx", "single"), (None, None, None), rows[0], rows[0], rows[0]]
    rows += [(" ".join(rng.choices(words, k=20_000)), "en", "long"), ("word\0word_word9word", "en", "a")]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, *r, 1, "v", "b", 2) for i, r in enumerate(rows)], SCHEMA).repartition(parts)


@pytest.mark.parametrize("parts, block_rows, lengths, top", [(3, 500_000, None, 200), (6, 50, [1, 2], 5)])
def test_audit_equals_brute_force(spark, parts, block_rows, lengths, top):
    rows = corpus()
    df = divergence.audit_sources(frame(spark, rows, parts), top=top, block_rows=block_rows, lengths=lengths)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, df.collect())) == brute(rows, top=top)


def test_every_level_counts_documents_once(spark):
    """A prefix shared by many terms of two documents has two documents, not many."""
    rows = [("aba abb abc abd", "en", "s"), ("abe abf abg", "en", "s"), ("zz zz zz", "en", "s"), ("zz", "en", "t"), ("zz", "en", "t")]
    chunks = frame(spark, rows, 1).selectExpr("lang", "source", "cast(text as binary) as text").mapInArrow(divergence._chunks, divergence.CHUNK_SCHEMA)
    level = chunks.mapInArrow(divergence._prefix_counts(2, 0, None), divergence.PREFIX_SCHEMA).collect()
    assert {bytes(r.prefix): r.docs for r in level} == {b"ab": 2, b"zz": 3}
    kept = divergence.kept_terms(chunks.cache(), 3).collect()
    assert [(r.lang, bytes(r.prefix)) for r in kept] == [("en", b"zz\0")]


def test_share_is_exact_beyond_64_bits():
    import numpy as np

    n, total = np.array([1, 10**13, 8 * 10**15 - 1]), np.array([8 * 10**15, 10**13, 8 * 10**15])
    assert divergence.share(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total)]


def test_empty_table(spark):
    assert divergence.audit_sources(frame(spark, [])).collect() == []
