"""What Spark makes of the queries: no products of tables, no row-by-row Python, narrow scans, early limits."""

import re

import pytest

from rillstone.plans import more_queries, queries, record_queries  # noqa: F401
from rillstone.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
#: these meet a table of a few names, or of one row, on purpose
SMALL_PRODUCTS = {"chunk_rtf_summary", "document_bleu", "corpus_bleu", "result_grid", "split_overlap", "count_split", "assembled_set"}


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_shape(spark, name):
    p = plan(spark, name)
    assert "BatchEvalPython" not in p
    assert "CartesianProduct" not in p
    if name not in SMALL_PRODUCTS:
        assert "BroadcastNestedLoopJoin" not in p


def test_group_limit_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "stratified_sample")


@pytest.mark.parametrize(("name", "columns"), [("hash_split", "doc_id:bigint"), ("rtf_statistics", "doc_id:bigint,text:string,n_chars:bigint"), ("fifo_playout", "event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double")])
def test_narrow_scans(spark, name, columns):
    found = {c for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name)) for c in s.split(",")}
    assert found == set(columns.split(","))


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,0)]" in plan(spark, "rtf_decisions")
