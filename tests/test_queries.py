"""Registered queries against their SQL. NEWSLOOM_ALL=1 runs all of them, otherwise a cross-section."""

import os

import pytest
from compare import compare, duck

from newsloom.plans.catalog import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"
SOME = ["canonicalize_url", "simhash64", "near_dup_pairs", "cluster_members", "explain_keywords", "insert_if_absent", "tag_entities",
        "pick_regions", "group_by_entity", "char_batches", "budget_select_tight", "change_pct", "downsample", "source_alerts",
        "parse_sections", "rss_items", "bot_messages", "stream_health"]


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("NEWSLOOM_ALL") else SOME)
def test_query(spark, con, name):
    ok, message, _, _ = compare(spark, ROOT, name, QUERIES[name], ORACLES.get(name), con)
    assert ok, message


def test_batch_and_stream_intake_agree(spark):
    if not os.path.isdir(ROOT):
        pytest.skip("driver tables not present")
    batch = QUERIES["enrich_items"](spark, ROOT).select("canonical_url", "source_id", "simhash64", "competitors").collect()
    stream = QUERIES["stream_ingest"](spark, ROOT).collect()
    assert {r.canonical_url for r in stream} == {r.canonical_url for r in batch}
    assert set(map(tuple, stream)) <= set(map(tuple, batch))
