import pytest
from pyspark.sql import functions as F

from moodspark.operators import skew
from tests.conftest import rows


@pytest.fixture(scope="module")
def tables(spark):
    many = [("hot", n) for n in range(300)] + [("warm", n) for n in range(20)]
    many += [("cold", 1), ("lost", 1)] + [(None, n) for n in range(50)]
    big = spark.createDataFrame(many, "k string, id int")
    lookup = spark.createDataFrame(
        [("hot", 1), ("warm", 2), ("cold", 3), ("extra", 4), (None, 5)], "k string, v int"
    )
    return big, lookup


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("counted", [False, True])
def test_same_as_a_plain_join(tables, how, counted):
    big, lookup = tables
    lookup = lookup.withColumn("n_rows", F.lit(9))  # a column like any other
    counts = skew.key_counts(big, ["k"]) if counted else None
    got = skew.balanced_join(big, lookup, ["k"], how, spread_by=["id"], counts=counts, rows_per_split=10)
    assert rows(got) == rows(big.join(lookup, "k", how).select(got.columns))
    assert ("n_rows" in got.columns) == (how in ("left", "inner"))


def test_hot_keys_are_few_and_sized(spark, tables):
    big, _ = tables
    counts = skew.key_counts(big, ["k"])
    # 372 rows over 8 partitions: a quarter of a partition's share is 11.6 rows
    assert rows(skew.hot_keys(counts, ["k"], 10)) == [("hot", 30), ("warm", 2)]
    even = spark.range(1_000).select((F.col("id") % 100).alias("k"))
    assert skew.hot_keys(skew.key_counts(even, ["k"]), ["k"], 1).count() == 0


def test_heavy_key_is_spread(spark):
    """The largest shuffle partition of the skewed side holds a small part of the hot key."""
    big = spark.range(20_000).select(F.lit("hot").alias("k"), "id")
    lookup = spark.createDataFrame([("hot", 1)], "k string, v int")
    joined = skew.balanced_join(
        big, lookup.hint("merge"), ["k"], "inner", spread_by=["id"], rows_per_split=500
    )
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert sum(sizes) == 20_000 and max(sizes) < 8_000


def test_other_joins_are_refused(tables):
    big, lookup = tables
    with pytest.raises(ValueError):
        skew.balanced_join(big, lookup, ["k"], "outer", spread_by=["id"])
