"""Repeatable samples and top-n.

Rows are ranked by a hash of the seed and a unique key.  Unlike ``sample`` or ``rand``
this does not depend on how rows are partitioned.
"""

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.fixed_values import (
    ARTICLE_PROMPT_COMMENTS,
    EVALUATION_ROWS,
    POST_PROMPT_COMMENTS,
    REPORT_QUOTES,
    REPORT_SUMMARIES,
    SAMPLE_SEED,
)


def shuffle_rank(keys: Sequence[str], seed: int = SAMPLE_SEED) -> Column:
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def first_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    k: int,
    rank: str | None = None,
) -> DataFrame:
    """The first k rows of each group.

    Ranked in three steps, each of which passes on at most k rows of a group from where it looks:
    a map task, then a part of the map tasks, then all.  The first rank filter sits on a window
    by group and part, so it is applied before the shuffle; a part is a number of the map task.
    So the task of a group that lies in all of M map tasks gets k rows of each part, not of
    each map task: some k * sqrt(M) rows.
    """
    name = rank or "_rank"
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, math.isqrt(partitions))
    columns = [c for c in df.columns if c != name]
    # the task's number decides only where a row is ranked first, never the result
    salted = df.select(*columns, (F.spark_partition_id() % parts).alias("_part"))
    for by, step in (([*group, "_part"], "_first"), (list(group), name)):
        w = Window.partitionBy(*by).orderBy(*order)
        salted = salted.withColumn(step, F.row_number().over(w)).where(F.col(step) <= k)
    return salted.select(*columns, *([name] if rank else []))


def first_captions(
    rows: DataFrame, counts: Mapping[str, Column], key: str = "post_url", caption: str = "post_caption"
) -> DataFrame:
    """key, the caption of its row with the least id, and the summed ``counts``, of every key.

    Captions are grouping keys and only numbers are combined, so rows are hashed, not sorted, and
    a task passes on one row per key and caption.  Among those few the first is picked.
    """
    texts = rows.groupBy(key, caption).agg(F.min("id").alias("_id"), *[c.alias(n) for n, c in counts.items()])
    whole = Window.partitionBy(key)
    first = F.row_number().over(whole.orderBy("_id", caption))
    sums = [F.sum(n).over(whole).alias(n) for n in counts]
    return texts.select(key, caption, *sums, first.alias("_first")).where("_first = 1").drop("_first")


def sample_per_group(
    df: DataFrame,
    group: Sequence[str],
    keys: Sequence[str],
    k: int = POST_PROMPT_COMMENTS,
    seed: int = SAMPLE_SEED,
) -> DataFrame:
    """At most k rows of each group at random; smaller groups are kept whole."""
    return first_per_group(df, group, [shuffle_rank(keys, seed), *keys], k)


def sample_rows(
    df: DataFrame, keys: Sequence[str], k: int = REPORT_QUOTES, seed: int = SAMPLE_SEED
) -> DataFrame:
    """At most k rows at random.  A top-k: each task keeps k rows, nothing is sorted whole."""
    return df.orderBy(shuffle_rank(keys, seed), *keys).limit(k)


def shuffled_head(
    df: DataFrame, keys: Sequence[str], k: int = REPORT_SUMMARIES, seed: int = SAMPLE_SEED
) -> DataFrame:
    """The first k rows of a shuffle; ``place`` sorts them in shuffled order."""
    return sample_rows(df, keys, k, seed).withColumn("place", shuffle_rank(keys, seed))


def first_comments(
    df: DataFrame,
    group: Sequence[str] = ("source", "article_id"),
    order: Sequence[str] = ("id",),
    k: int = ARTICLE_PROMPT_COMMENTS,
) -> DataFrame:
    return first_per_group(df, group, order, k)


def first_rows(df: DataFrame, order: Sequence[str], k: int = EVALUATION_ROWS) -> DataFrame:
    return df.orderBy(*order).limit(k)
