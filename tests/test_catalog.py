"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from moodspark import catalog
from tests.parity import compare, open_tables

SF = "/root/testdata/sf0.001"
PYTHON = {
    "plugin_labels", "generated_article_summaries", "generated_post_summaries",
    # one scan of the tags in Arrow batches
    "page_links", "page_links_by_pattern", "page_menu_links", "page_articles", "page_records", "page_text_records",
    "voted_comments", "reaction_counters",
    # one automaton for all keywords
    "relevant_documents", "relevant_documents_default_topics", "relevance_delete_counts", "predictions_for_hand_labels",
}
catalog.load_all()
NAMES = list(catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    return open_tables(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    assert compare(spark, duck, SF, catalog.QUERIES[name], catalog.SQL[name]) is None


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan
    if name not in PYTHON:
        for operator in ("Python", "MapInArrow", "MapInPandas"):
            assert operator not in plan
    # a window over everything would run in one task
    assert not any(operator.startswith("Window") for operator in above_single_partition(plan))


def above_single_partition(plan):
    """The operators that read all rows in one task: the nearest above each such exchange but sorts."""
    lines = [(len(line) - len(line.lstrip(" :+-*()0123456789")), line.lstrip(" :+-*()0123456789")) for line in plan.splitlines()]
    for k, (depth, text) in enumerate(lines):
        if not text.startswith("Exchange SinglePartition"):
            continue
        for at, operator in reversed(lines[:k]):
            if at < depth:
                depth = at
                if not operator.startswith(("Sort", "AQEShuffleRead", "ShuffleQueryStage")):
                    yield operator
                    break


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["article_id", "source", "mood"] and df.count() == 200


def test_a_window_over_everything_is_seen(spark):
    df = spark.range(9).selectExpr("id", "row_number() OVER (ORDER BY id % 3, id) AS r")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert any(operator.startswith("Window") for operator in above_single_partition(plan))
