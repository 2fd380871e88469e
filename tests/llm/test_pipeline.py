"""Stages of the corpus pipeline: columns kept, decisions applied, odd rows survive."""

import random
from functools import partial

import pytest
from test_operators import SCHEMA, brute_components, corpus, frame, phrases, prose

import corpus_pipeline
from newsloom.llm import jaccard, queries

FIELDS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    item = prose(rng, 40, 10**6)
    rows = corpus() + [(900, prose(rng, 50) + " " + item), (901, prose(rng, 60) + " password=hunter2hunter2 " + prose(rng, 60)), (902, None)]
    frame(spark, rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "https://a.example.com/en/7", "<p>x</p>"), (2, None, None)], "page_id long, url string, html string").write.parquet(
        f"{root}/pages.parquet")
    return root


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources to target weights"]
    for name, stage in list(stages.items())[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = out.collect()
        ids = [r.doc_id for r in got]
        if name == "n-gram Jaccard join":
            assert len([i for i in ids if i in range(11, 51)]) < 12 and 5 in ids
            assert sum(r.text is None for r in got) == sum(r.text is None for r in docs.collect())
        elif name == "benchmark decontamination":
            assert 900 not in ids and 901 in ids and len(got) == docs.count() - 1
        elif name == "secret scans":
            text = next(r for r in got if r.doc_id == 901)
            assert "hunter2" not in text.text and "[redacted]" in text.text and text.n_chars == len(text.text)
            assert len(got) == docs.count() and {r.doc_id for r in got if r.text is None} == {0, None, 902}
        else:
            assert all(r.text and r.text.strip() for r in got)


def test_near_duplicates_between_the_thresholds(spark, tmp_path):
    """Pairs that link on five words and 80 % but not on four words and 85 %, and pairs just outside, against brute force."""
    rng, rows = random.Random(21), []
    for n, edits in ((48, 1), (49, 1), (50, 1), (52, 1), (94, 2), (101, 2), (139, 3), (150, 3), (30, 1)):
        w = prose(rng, n, 10**6).split()
        rows.append((len(rows), " ".join(w)))
        for k in range(edits):
            w[(k + 1) * n // (edits + 1)] = f"changed{k}"
        rows.append((len(rows), " ".join(w)))
    frame(spark, rows).write.parquet(str(tmp_path / "d"))
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path))
    wide, narrow = ({i for i, _, low in brute_components(rows, *k) if i == low} for k in ((5, 80), (4, 85)))
    assert len(narrow - wide) > 4
    assert {r.doc_id for r in got.collect()} == wide


def test_near_duplicates_with_phrases_in_common(spark, tmp_path, monkeypatch):
    """The stage cuts no block for documents that only have phrases in common."""
    def cut(*_):
        raise AssertionError("a chain of phrases has become one block")

    rows = phrases()
    monkeypatch.setattr(jaccard, "_split_large", cut)
    monkeypatch.setattr(jaccard, "near_components", partial(jaccard.near_components, block_shingles=800))
    frame(spark, rows).write.parquet(str(tmp_path / "d"))
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path))
    assert {r.doc_id for r in got.collect()} == {i for i, _, low in brute_components(rows, 5, 80) if i == low} == {i for i, _ in rows if i % 2 == 0}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert set(FIELDS) <= set(out.columns) and "pass_no" in out.columns
    rows = out.collect()
    assert rows and 900 not in {r.doc_id for r in rows}
    assert not any("hunter2" in (r.text or "") for r in rows)
    assert len({(r.doc_id, r.text, r.pass_no) for r in rows}) == len(rows)


def test_empty_run(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0


def test_all_queries_run(spark, folder):
    for name, query in vars(queries).items():
        if name.startswith("op"):
            out = query(spark, folder)
            assert len(set(out.columns)) == len(out.columns)
            out.collect()
