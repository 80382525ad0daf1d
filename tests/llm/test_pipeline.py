"""The registered queries and the pipeline over the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from moodspark.llm import catalog
from moodspark.llm.common import stage
from tests.parity import compare, open_tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, name):
    assert compare(spark, open_tables(SF), SF, catalog.QUERIES[name], catalog.SQL[name]) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = stage(corpus_pipeline.STAGES[-1][1](spark, docs, SF), "packed")
    assert packed.select("doc_id").distinct().count() == before


def test_scores_leave_no_row_out(spark):
    rows = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    for name in ("op5_quality", "op6_personal_data", "op7_toxicity"):
        assert catalog.QUERIES[name](spark, SF).count() == rows


def test_stages_take_any_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing columns and an empty table go through every stage."""
    item = "the old house by the river was sold in spring to a family from the next town"
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0), (2, 1), (None, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    words = [f"w{k}" for k in range(40)]
    rows = [
        (1, " ".join(words), "a"), (2, " ".join([*words, "more"]), "b"), (3, f"so {item}", "c"), (3, f"so {item}", "c"),
        (4, None, None), (5, "", "e"), (None, "no id", None), (None, "no id", None), (6, "\n" * 200_000, "f"),
    ]
    names = "doc_id long, text string, component_id string"
    docs = spark.createDataFrame(rows, names)
    ids = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "component_id"]
        ids[name] = sorted((r.doc_id for r in docs.collect()), key=str)
    assert ids["line_dedup"] == ids["toxicity"] == sorted([1, 2, 3, 3, 4, 5, 6, None, None], key=str)
    assert ids["near_dedup"] == sorted([1, 3, 3, 4, 5, 6, None, None], key=str)
    assert ids["decontamination"] == sorted([1, 4, 5, 6, None, None], key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len([r for r in packed if r.piece == 0]) == 6
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), str(tmp_path)).count() == 0
