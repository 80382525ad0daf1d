"""Labels -> mood per article, post and source.

Label counts are conditional counts over a closed set of labels.  That is one aggregate
with one shuffle of already combined rows, where a pivot would shuffle twice, and it
gives every label a column even if the data holds none of it.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.fixed_values import (
    LABELS,
    MOODS,
    NO_COMMENT,
    REACTION_LABELS,
    REPORT_TOP_LABELS,
)


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def label_counts(label: str = "sentiment") -> dict[str, Column]:
    return {name: F.count_if(F.col(label) == name) for name in LABELS}


def count_labels(df: DataFrame, keys: str | Sequence[str], label: str = "sentiment") -> DataFrame:
    """Comments per key and label, one column per label, 0 where there are none."""
    return df.groupBy(*_keys(keys)).agg(*[c.alias(name) for name, c in label_counts(label).items()])


def plurality(
    positive: Column | None = None, neutral: Column | None = None, negative: Column | None = None
) -> Column:
    """The label with strictly more votes than each other one; any tie is neutral."""
    pos = F.col("positive") if positive is None else positive
    neu = F.col("neutral") if neutral is None else neutral
    neg = F.col("negative") if negative is None else negative
    return (
        F.when(pos > F.greatest(neg, neu), F.lit("positive"))
        .when(neg > F.greatest(pos, neu), F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def comment_mood(
    df: DataFrame, keys: str | Sequence[str], label: str = "sentiment"
) -> DataFrame:
    """Label counts and mood per key."""
    return count_labels(df, keys, label).withColumn("mood", plurality())


def map_reaction(name: Column | str, labels: Mapping[str, str] = REACTION_LABELS) -> Column:
    """Label of a reaction; null for a name that has none.  The map is a literal, so no join."""
    name = F.col(name) if isinstance(name, str) else name
    out: Column | None = None
    for label in sorted(set(labels.values())):
        names = [n for n, lab in labels.items() if lab == label]
        out = (F if out is None else out).when(name.isin(names), F.lit(label))
    return out


def sum_reactions(
    df: DataFrame,
    keys: str | Sequence[str],
    labels: Mapping[str, str] = REACTION_LABELS,
    name: str = "emotion",
    count: str = "count",
) -> DataFrame:
    """Sum of reaction counts per key and label; names without a label are dropped."""
    labelled = df.withColumn("_label", map_reaction(name, labels)).where(
        F.col("_label").isNotNull()
    )
    zero = F.lit(0).cast("bigint")
    return labelled.groupBy(*_keys(keys)).agg(
        *[
            F.coalesce(
                F.sum(F.when(F.col("_label") == lab, F.col(count).cast("bigint"))), zero
            ).alias(lab)
            for lab in LABELS
        ]
    )


def dominant_label() -> Column:
    """The label with the largest sum; ties go to positive, then neutral."""
    pos, neu, neg = F.col("positive"), F.col("neutral"), F.col("negative")
    return (
        F.when((pos >= neu) & (pos >= neg), F.lit("positive"))
        .when(neu >= neg, F.lit("neutral"))
        .otherwise(F.lit("negative"))
    )


def reaction_mood(
    df: DataFrame,
    keys: str | Sequence[str],
    labels: Mapping[str, str] = REACTION_LABELS,
    name: str = "emotion",
    count: str = "count",
) -> DataFrame:
    return sum_reactions(df, keys, labels, name, count).withColumn(
        "dominant_sentiment", dominant_label()
    )


def attach_mood(
    articles: DataFrame, moods: DataFrame, keys: str | Sequence[str] = "article_id"
) -> DataFrame:
    """Every article with its comment mood, null where nobody commented."""
    keys = _keys(keys)
    return articles.join(moods.select(*keys, "mood"), keys, "left")


def override_mood(
    articles: DataFrame, reactions: DataFrame, keys: str | Sequence[str] = "article_id"
) -> DataFrame:
    """Reaction mood in place of comment mood, where there is one."""
    keys = _keys(keys)
    joined = articles.join(reactions.select(*keys, "dominant_sentiment"), keys, "left")
    return joined.withColumn(
        "mood", F.coalesce(F.col("dominant_sentiment"), F.col("mood"))
    ).drop("dominant_sentiment")


def fill_mood(articles: DataFrame) -> DataFrame:
    return articles.fillna({"mood": NO_COMMENT})


def majority_of_counts(counts: DataFrame, ties: Sequence[str] = tuple(sorted(LABELS))) -> DataFrame:
    """``average_sentiment`` in place of the counts of each label: the most frequent one.

    Of equals the first in ``ties`` counts.  Rows whose counts are all 0 are left out.
    """
    if sorted(ties) != sorted(LABELS):
        raise ValueError(f"ties must name each of {LABELS}")
    top = F.greatest(*[F.col(name) for name in LABELS])
    pick = F.when(top == 0, F.lit(None).cast("string"))
    for name in ties:
        pick = pick.when(F.col(name) == top, F.lit(name))
    return (
        counts.withColumn("average_sentiment", pick)
        .where(F.col("average_sentiment").isNotNull())
        .drop(*LABELS)
    )


def majority_label(
    df: DataFrame,
    keys: str | Sequence[str] = "post_url",
    label: str = "sentiment",
    ties: Sequence[str] = tuple(sorted(LABELS)),
) -> DataFrame:
    """Most frequent label per key; of equals the first in ``ties``, in alphabetical order if not given.

    Rows without a key are left out.  A key whose labels are all null has no majority.
    """
    keys = _keys(keys)
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return majority_of_counts(count_labels(known, keys, label), ties)


def mood_distribution(
    articles: DataFrame, keys: str | Sequence[str] = (), mood: str = "mood"
) -> DataFrame:
    """Articles per mood and their share; all four moods are listed, also those with none.

    Per key if keys are given.  One aggregate: the counts fit one row, so the shares need
    no second pass.
    """
    keys = _keys(keys)
    counts = articles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col(mood) == m).alias(f"_{i}") for i, m in enumerate(MOODS)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("mood"),
                F.col(f"_{i}").alias("n_articles"),
                F.try_divide(F.col(f"_{i}").cast("double"), F.col("_total").cast("double")).alias(
                    "share"
                ),
            )
            for i, m in enumerate(MOODS)
        ]
    )
    return counts.select(*keys, F.inline(rows))


def top_labels(df: DataFrame, label: str, k: int = REPORT_TOP_LABELS) -> DataFrame:
    """The k most frequent labels."""
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col(label))
        .limit(k)
    )


def article_moods(
    articles: DataFrame,
    labelled_comments: DataFrame,
    reactions: DataFrame,
    labels: Mapping[str, str] = REACTION_LABELS,
    keys: str | Sequence[str] = "article_id",
) -> DataFrame:
    """Mood of every article: reactions first, then comments, else 'no comment'.

    Comments and reactions are combined per article before they meet the articles, so
    however many comments one article has, both joins are one row to one row.
    """
    moods = comment_mood(labelled_comments, keys)
    dominant = reaction_mood(reactions, keys, labels)
    return fill_mood(override_mood(attach_mood(articles, moods, keys), dominant, keys))
