"""Joins that stay balanced when one key holds a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SPLIT = 1_000_000


def key_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def hot_keys(
    counts: DataFrame, keys: Sequence[str], rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """The heaviest keys and into how many parts each is to be split.

    A key is heavy if it has more than ``rows_per_split`` rows and more than a quarter of what
    a shuffle partition has on average.  So there are never more than four heavy keys to a
    shuffle partition, and the result may be broadcast.
    """
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fair = counts.agg((F.sum("n_rows") / (4 * partitions)).alias("n")).scalar()
    known = counts.where(F.col("n_rows") > F.greatest(F.lit(rows_per_split), F.coalesce(fair, F.lit(0))))
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.select(*keys, _splits(rows_per_split).alias("_splits"))


def balanced_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str,
    *,
    spread_by: Sequence[str],
    counts: DataFrame | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Join ``rows`` to a ``lookup`` that has one row per key; ``rows`` may be skewed.

    Each heavy key is cut into parts of about ``rows_per_split`` rows by a hash of
    ``spread_by`` (columns that tell rows of one key apart), and only its lookup row is
    repeated once per part.  All other keys are joined as they are.  The parts depend on
    row values alone, so a task that is run again makes the same ones.

    ``counts`` (keys, n_rows): rows per key if they are known already.
    ``how``: left, inner, left_semi or left_anti.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"the lookup side cannot be preserved: {how}")
    keys = list(keys)
    if counts is None:
        counts = key_counts(rows, keys)
    hot = F.broadcast(hot_keys(counts, keys, rows_per_split))
    mixed = F.xxhash64(*[F.col(c) for c in spread_by])
    # rows with a null key match nothing; a negative part keeps them apart from each other
    no_key = _any_null(keys)
    part = (
        F.when(no_key, -1 - F.pmod(mixed, F.lit(1_000_003)))
        .when(F.col("_splits").isNotNull(), F.pmod(mixed, F.col("_splits")))
        .otherwise(F.lit(0))
        .cast("int")
    )
    left = rows.join(hot, keys, "left").withColumn("_part", part).drop("_splits")
    sized = lookup.join(hot, keys, "left")
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)
    right = sized.withColumn("_part", F.explode(parts)).drop("_splits")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def _splits(rows_per_split: int) -> Column:
    return F.ceil(F.col("n_rows") / rows_per_split).cast("int")


def _any_null(keys: Sequence[str]) -> Column:
    found = F.lit(False)
    for k in keys:
        found = found | F.col(k).isNull()
    return found
