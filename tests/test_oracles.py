import os

import pytest

from korpusflow.plans import registry
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, name):
    assert differences(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_block_search_equals_nested_loop(spark):
    a, b = ({tuple(r) for r in registry.QUERIES[name](spark, SF).collect()} for name in ("dense_topk", "dense_topk_blocks"))
    assert a == b


def test_approximate_search_recall(spark):
    a = {(r.query_id, r.chunk_id) for r in registry.QUERIES["dense_topk"](spark, SF).collect()}
    b = {(r.query_id, r.chunk_id) for r in registry.QUERIES["ann_topk"](spark, SF).collect()}
    assert len(b) == len(a) and len(a & b) >= 0.9 * len(a)


def test_plans_stay_in_the_jvm(spark):
    for name in ("bm25_topk", "rrf_hybrid", "pack_budget", "deadline_business_days", "html_text_sql", "recall_ndcg_at_10"):
        text = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text, name
    text = registry.QUERIES["latest_version"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "props" not in text  # top-n is pruned early, unused columns are not read
