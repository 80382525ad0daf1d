"""Predictions against hand labels.

The matrix counts every pair of a short, fixed list of labels into a single row; the scores count
the pairs that occur.  Nothing is joined.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.fixed_values import EVALUATION_LABELS


def _pair_counts(df: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    return df.agg(
        *[
            F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).alias(f"_{i}_{j}")
            for i, t in enumerate(labels)
            for j, p in enumerate(labels)
        ]
    )


def confusion_matrix(
    df: DataFrame,
    truth: str = "true_sentiment",
    predicted: str = "sentiment",
    labels: Sequence[str] = EVALUATION_LABELS,
) -> DataFrame:
    """truth, predicted, n for every pair of labels, also those that never occur."""
    cells = F.array(
        *[
            F.struct(
                F.lit(t).alias("truth"), F.lit(p).alias("predicted"), F.col(f"_{i}_{j}").alias("n")
            )
            for i, t in enumerate(labels)
            for j, p in enumerate(labels)
        ]
    )
    return _pair_counts(df, truth, predicted, labels).select(F.inline(cells))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom.cast("double"))


def _class_scores(
    df: DataFrame, truth: str, predicted: str, labels: Sequence[str] | None
) -> DataFrame:
    """One row: an array ``_classes`` of scores in label order, ``_hits`` and ``_total``.

    The rows are counted by pair before their shuffle; what meets in one task is a row per class.
    The scores are worked out in steps over the array, each from the fields of the one
    before, so that no expression is written out more than once.
    """
    t, p, n = F.col("_t"), F.col("_p"), F.col("_n")
    pairs = df.select(F.col(truth).alias("_t"), F.col(predicted).alias("_p")).where(
        t.isNotNull() & p.isNotNull()
    )
    if labels is not None:
        pairs = pairs.where(t.isin(*labels) & p.isin(*labels))
    pairs = pairs.groupBy("_t", "_p").agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(t == p, n).otherwise(F.lit(0).cast("long"))
    none = F.lit(0).cast("long")

    def side(label: Column, hits: Column, support: Column, guesses: Column) -> Column:
        return F.struct(
            label.alias("label"), hits.alias("hits"), support.alias("support"), guesses.alias("guesses")
        )

    sides = pairs.select(F.inline(F.array(side(t, hit, n, none), side(p, none, none, n))))
    classes = sides.groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("hits", "support", "guesses")]
    )
    whole = classes.agg(
        F.sort_array(F.collect_list(F.struct("label", "hits", "support", "guesses"))).alias("_seen"),
        F.coalesce(F.sum("hits"), none).alias("_hits"),
        F.coalesce(F.sum("support"), none).alias("_total"),
    )
    seen = F.col("_seen")
    rates = F.transform(
        seen,
        lambda s: F.struct(
            s["label"].alias("label"),
            _ratio(s["hits"], s["guesses"]).alias("precision"),
            _ratio(s["hits"], s["support"]).alias("recall"),
            s["support"].alias("support"),
        ),
    )

    def f1(s: Column) -> Column:
        both = s["precision"] + s["recall"]
        return F.when(both == 0, F.lit(0.0)).otherwise(
            F.lit(2.0) * s["precision"] * s["recall"] / both
        )

    scores = F.transform(
        rates,
        lambda s: F.struct(
            s["label"].alias("label"),
            s["precision"].alias("precision"),
            s["recall"].alias("recall"),
            f1(s).alias("f1"),
            s["support"].alias("support"),
        ),
    )
    return whole.select(scores.alias("_classes"), "_hits", "_total")


def _mean(field: str) -> Column:
    total = F.aggregate("_classes", F.lit(0.0), lambda acc, s: acc + s[field])
    return _ratio(total, F.size("_classes"))


def _weighted(field: str) -> Column:
    total = F.aggregate("_classes", F.lit(0.0), lambda acc, s: acc + s[field] * s["support"])
    return _ratio(total, F.col("_total"))


def classification_report(
    df: DataFrame,
    truth: str = "true_sentiment",
    predicted: str = "sentiment",
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """label, precision, recall, f1, support: a row per class that occurs in truth or
    prediction, then accuracy, macro avg and weighted avg.  Dividing by zero gives 0.

    All labels count; with ``labels``, only rows whose truth and prediction are among them."""
    rows = _class_scores(df, truth, predicted, labels)
    nothing = F.lit(None).cast("double")
    def summary(name: str, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            F.col("_total").alias("support"),
        )

    summaries = F.array(
        summary("accuracy", nothing, nothing, _ratio(F.col("_hits"), F.col("_total"))),
        summary("macro avg", _mean("precision"), _mean("recall"), _mean("f1")),
        summary("weighted avg", _weighted("precision"), _weighted("recall"), _weighted("f1")),
    )
    return rows.select(F.inline(F.concat(F.col("_classes"), summaries)))


def macro_f1(
    df: DataFrame,
    truth: str = "true_sentiment",
    predicted: str = "sentiment",
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """One row: mean F1 of the classes that occur in truth or prediction."""
    return _class_scores(df, truth, predicted, labels).select(_mean("f1").alias("macro_f1"))
