"""SimHash near-dedup against brute force over all pairs of fingerprints."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import variants

SCHEMA = "doc_id long, text string, lang string, fp string, component string, n int, first string, h long"


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[i + 1:]:
            if bin(x ^ y).count("1") <= 4:
                parent[find(x)] = find(y)
    low = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            low[find(p)] = min(low.get(find(p), i), i)
    return sorted((str(i), f"{p:016x}", str(low.get(find(p)))) for (i, _), p in zip(rows, prints))


def corpus():
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(30, 400))) for _ in range(12)]
    texts = [None, "", " \n\t", "one", "One", "two words", "a b c", "a b c d", "É ÜBER\u00a0x", base[0].upper(), "x " * 400, " ".join(f"z{i % 7}" for i in range(130_000))]
    for t in base:
        for k in range(14):
            w = t.split()
            for _ in range(k % 5):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rows = [(i + 10, t) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "alone and without an id here"), (None, base[1]), (None, None), (1, base[2])]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "x", "y", 5, "z", 9) for i, t in rows], SCHEMA).repartition(parts)


def got(df):
    out = df.select("doc_id", variants.hex_print(F.col("fp")).alias("p"), "component_id").collect()
    return sorted((str(r.doc_id), r.p, str(r.component_id)) for r in out)


@pytest.mark.parametrize("parts, limit", [(3, 50_000), (9, 20)])
def test_components_equal_brute_force(spark, parts, limit):
    rows = corpus()
    expected = brute(rows)
    assert len({c for _, _, c in expected}) < len({p for _, p, _ in expected})  # there are links between different fingerprints
    assert got(variants.near_components(frame(spark, rows, parts), limit=limit)) == expected


def test_masks_are_complete():
    rng = random.Random(3)
    for mask in (0, (1 << 21) - 2, rng.getrandbits(64)):
        masks = variants.variant_masks(mask)
        for _ in range(400):
            x = 0
            for b in rng.sample([b for b in range(64) if not mask >> b & 1], 4):
                x |= 1 << b
            assert any(x & m == 0 for m in masks)
    assert len(variants.variant_masks(0)) == 64


def test_pieces_of_long_texts(monkeypatch):
    texts = [b"", b"a b c d e f g h i j k l m", b"q", b" ".join(b"%d" % (i * i % 89) for i in range(500))]
    hashes = [variants.shingle_hashes(t) for t in texts]
    whole = variants.majority(hashes)
    monkeypatch.setattr(variants, "PIECE", 7)
    assert variants.majority(hashes).tolist() == whole.tolist() == [fingerprint(t.decode()) for t in texts]


def test_empty_table(spark):
    assert variants.near_components(frame(spark, [])).collect() == []
    assert got(variants.near_components(frame(spark, [(1, None), (2, " ")]))) == [("1", "0" * 16, "1"), ("2", "0" * 16, "1")]
