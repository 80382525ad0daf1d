"""Projections, filters, stacking and profiles."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.fixed_values import DEFAULT_LABEL
from moodspark.functions.text import is_blank, is_noise, strip


def tag_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source))


def namespaced_key(key: Column | str, source: Column | str, prefix: bool = False) -> Column:
    """'17' + 'web' -> '17web', or 'web17' with ``prefix``; ``source`` text is taken literally."""
    key = (F.col(key) if isinstance(key, str) else key).cast("string")
    source = F.lit(source) if isinstance(source, str) else source
    return F.concat(source, key) if prefix else F.concat(key, source)


def normalise_article(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """``content`` becomes ``text`` where it exists; then keep ``columns`` if any are named."""
    renamed = df.withColumnRenamed("content", "text")
    return renamed.select(*columns) if columns else renamed


def drop_noise(df: DataFrame, column: str) -> DataFrame:
    """Drop symbol-only, short and mention-only texts; keep the others trimmed."""
    return df.where(~is_noise(column)).withColumn(column, strip(column))


def where_text(df: DataFrame, column: str) -> DataFrame:
    return df.where(~is_blank(column))


def where_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def drop_unlabelled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def fill_labels(
    df: DataFrame, columns: Sequence[str], label: str = DEFAULT_LABEL
) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(label)) for c in columns}
    )


def stack(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per frame: its name and number of rows."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("frame"), "n_rows")
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, non-null and null values.  One pass over the table.

    Columns are typed, so a column holds values of its type and nulls: the two counts are
    also the counts by value type.
    """
    names = df.columns
    totals = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.col(f"`{n}`")).alias(f"_{i}") for i, n in enumerate(names)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("column_name"),
                F.lit(t).alias("data_type"),
                F.col("n_rows"),
                F.col(f"_{i}").alias("non_null"),
                (F.col("n_rows") - F.col(f"_{i}")).alias("nulls"),
            )
            for i, (n, t) in enumerate(df.dtypes)
        ]
    )
    return totals.select(F.inline(rows))
