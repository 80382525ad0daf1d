import hashlib

import pytest

from pyspark.sql import functions as F

from moodspark.operators import sampling
from tests.conftest import rows


def md5(*parts):
    return hashlib.md5(":".join(["42", *map(str, parts)]).encode()).hexdigest()


@pytest.fixture(scope="module")
def table(spark):
    data = [("big", n) for n in range(51)] + [("exact", n) for n in range(100, 150)] + [("one", 999)]
    return spark.createDataFrame(data, "post string, id int")


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_samples_do_not_depend_on_partitions(table, parts):
    df = table.repartition(parts)
    picked = {(p, n) for p, n in rows(sampling.sample_per_group(df, ["post"], ["id"]))}
    left_out = max(range(51), key=lambda n: (md5(n), n))
    assert {n for p, n in picked if p == "big"} == set(range(51)) - {left_out}
    assert sum(p == "exact" for p, _ in picked) == 50 and ("one", 999) in picked
    ids = [n for _, n in table.collect()]
    expected = sorted(ids, key=lambda n: (md5(n), n))
    assert {n for _, n in rows(sampling.sample_rows(df, ["id"]))} == set(expected[:10])
    head = sorted((r.place, r.id) for r in sampling.shuffled_head(df, ["id"]).collect())
    assert [n for _, n in head] == expected[:5]
    first = rows(sampling.first_comments(df, ["post"], ["id"]))
    assert first == sorted([("big", n) for n in range(5)] + [("exact", n) for n in range(100, 105)] + [("one", 999)], key=repr)
    assert {r.id for r in sampling.first_rows(df, ["id"], 3).collect()} == {0, 1, 2}


def test_rank_limit_comes_before_the_shuffle(table):
    plan = sampling.sample_per_group(table, ["post"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_a_group_in_all_map_tasks(spark):
    """No task gets k rows of every map task: ranks are taken for parts of the tasks first."""
    df = spark.range(40_000, numPartitions=40).selectExpr("id", "IF(id % 3 = 0, 0, id) AS g", "id % 97 AS o")
    got = sampling.first_per_group(df, ["g"], ["o", "id"], 5, rank="r")
    hot = got.where("g = 0").orderBy("r").collect()
    want = sorted((k % 97, k) for k in range(0, 40_000, 3))[:5]
    assert [(r.o, r.id, r.r) for r in hot] == [(*w, n) for n, w in enumerate(want, 1)]
    assert got.columns == ["id", "g", "o", "r"] and got.count() == 5 + 40_000 - len(range(0, 40_000, 3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and plan.count("hashpartitioning") == 2


def test_first_captions(spark):
    data = [("u", 3, "c"), ("u", 1, None), ("u", 2, "b"), ("v", 9, "x"), ("v", 9, "w"), (None, 1, "n")]
    df = spark.createDataFrame(data, "post_url string, id int, post_caption string")
    got = sampling.first_captions(df, {"n": F.count("post_caption")})
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("u", None, 2), ("v", "w", 2), (None, "n", 1)], key=str)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
