"""Keyed maintenance of tables: upsert, insert-if-absent, replace children."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.operators.skew import ROWS_PER_SPLIT, balanced_join


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # filtering the row number lets each map task keep one row per key before the shuffle
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _one_per_key(df, keys, [F.col(c).asc() for c in order])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _one_per_key(df, keys, [F.col(c).desc() for c in order])


def without_keys(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``base`` whose key is not in ``other``; null is a key like any other."""
    named = other.select(*[F.col(k).alias(f"_other_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys])
    return base.join(named, same, "left_anti")


def upsert(
    base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Insert or replace by key; of several rows for a key in ``delta`` the last one wins.

    Null is a key like any other, so a second run with the same delta changes nothing.
    """
    newest = last_per_key(delta, list(keys), order)
    return without_keys(base, newest, keys).unionByName(newest)


def insert_missing(
    base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Add rows whose key is not there yet; of several rows for a key the first one counts.

    Null is a key like any other.
    """
    added = without_keys(first_per_key(delta, list(keys), order), base.select(*keys), keys)
    return base.unionByName(added)


def replace_children(
    base: DataFrame,
    delta: DataFrame,
    refreshed: DataFrame,
    foreign_key: Sequence[str],
    spread_by: Sequence[str],
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Drop the children of every refreshed parent, then add the new ones.

    ``refreshed`` lists the parents, since a parent that now has no children loses its old
    ones all the same.  One parent may own a large share of ``base``: see balanced_join.
    """
    foreign_key = list(foreign_key)
    parents = refreshed.select(*foreign_key).distinct()
    kept = balanced_join(
        base, parents, foreign_key, "left_anti",
        spread_by=spread_by, rows_per_split=rows_per_split,
    )
    return kept.select(*base.columns).unionByName(delta)


def with_key(df: DataFrame, natural_key: str, name: str = "id") -> DataFrame:
    """Surrogate key from the natural one; parents and children compute it alone, no counter."""
    return df.withColumn(name, F.md5(F.col(natural_key).cast("string")))
