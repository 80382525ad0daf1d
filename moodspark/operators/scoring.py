"""Labelling texts: the default lexicon, a caller's function, or a fitted Spark ML model."""

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.fixed_values import DEFAULT_LABEL, LABELS
from moodspark.functions.lexicon import DEFAULT_LEXICON, lexicon_label
from moodspark.functions.text import WORD_CHARS, is_blank, label_at
from moodspark.operators.skew import ROWS_PER_SPLIT, balanced_join
from moodspark.sources.tables import save_stage

ScorerFactory = Callable[[], Callable[[pd.Series], Sequence[int]]]


def check_labels(labels: Sequence[str]) -> None:
    unknown = [x for x in labels if x not in LABELS]
    if unknown:
        raise ValueError(f"not in {LABELS}: {unknown}")


def score_lexicon(
    df: DataFrame,
    column: str,
    lexicon: Mapping[str, int] = DEFAULT_LEXICON,
    label: str = "sentiment",
) -> DataFrame:
    """Label by the lexicon, in place: no shuffle."""
    return df.withColumn(label, lexicon_label(F.col(column), lexicon))


def score_lexicon_table(
    df: DataFrame,
    column: str,
    lexicon: DataFrame,
    keys: Sequence[str],
    label: str = "sentiment",
) -> DataFrame:
    """Label by a lexicon of any size, a table of (word, weight) with each lower-case word once.

    ``keys`` tell the rows apart and are not null.  Words are counted per text before they meet the
    lexicon, by a join that cuts the words of very many texts into parts; what is found is summed
    per text.  Whole weights give exact sums.  Texts without a known word are neutral.
    """
    keys = list(keys)
    inner = f"(?:'[{WORD_CHARS}]+)*"  # an apostrophe between letters is part of the word
    tokens = F.regexp_extract_all(
        F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(f"[{WORD_CHARS}]+{inner}"), F.lit(0)
    )
    counted = df.select(*keys, F.explode(tokens).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("_n"))
    known = balanced_join(counted, lexicon.select("word", "weight"), ["word"], "inner", spread_by=keys)
    scores = known.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("_n")).alias("_score"))
    sign = F.signum(F.coalesce(F.col("_score"), F.lit(0))).cast("int")
    named = F.array(F.lit("negative"), F.lit(DEFAULT_LABEL), F.lit("positive"))
    return df.join(scores, keys, "left").withColumn(label, F.element_at(named, sign + 2)).drop("_score")


def _text_key(text: Column) -> Column:
    # never null, and known to be so: joins add no null check that hashes once more
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    """Every non-blank text once, with a key and the number of rows that hold it.

    Copies are combined on the map side, so a text that fills a third of the table reaches
    its task once per map task.
    """
    return (
        df.where(~is_blank(column))
        .groupBy(F.col(column).alias("text"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(_text_key(F.col("text")).alias("text_key"), "text", "n_rows")
    )


def label_texts(texts: DataFrame, scorer: ScorerFactory, labels: Sequence[str]) -> DataFrame:
    """text_key, n_rows, label for a table of distinct texts.

    ``scorer()`` runs once per task and loads the model; the function it returns takes a
    batch of texts and gives class indexes into ``labels``.  Texts arrive whole; a model's
    own input limit is the scorer's business.
    """
    check_labels(labels)

    @F.pandas_udf("int")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer()
        for batch in batches:
            yield pd.Series(score(batch), index=batch.index, dtype="int32")

    return texts.select("text_key", "n_rows", label_at(classify("text"), labels).alias("label"))


def _join_labels(
    df: DataFrame,
    column: str,
    scored: DataFrame,
    counts: DataFrame,
    spread_by: Sequence[str],
    label: str,
    rows_per_split: int,
) -> DataFrame:
    # blank rows get no key: they match nothing and are spread, then take the default label
    keyed = df.withColumn(
        "text_key", F.when(~is_blank(column), _text_key(F.col(column)))
    )
    joined = balanced_join(
        keyed,
        scored.select("text_key", F.col("label").alias(label)),
        ["text_key"],
        "left",
        spread_by=spread_by,
        counts=counts.select("text_key", "n_rows"),
        rows_per_split=rows_per_split,
    )
    filled = F.when(F.col("text_key").isNull(), F.lit(DEFAULT_LABEL)).otherwise(F.col(label))
    return joined.withColumn(label, filled).select(*df.columns, label)


def score_text(
    df: DataFrame,
    column: str,
    scorer: ScorerFactory,
    labels: Sequence[str],
    *,
    spread_by: Sequence[str],
    label: str = "sentiment",
    keep: bool = False,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Label every row with a caller's model; blank text is neutral and never reaches it.

    Each distinct text is scored once and its label joined back.  ``spread_by`` names
    columns that tell rows with the same text apart, usually the comment id.  With ``keep``
    the labels are written first, so using the result twice runs the model once.
    """
    texts = distinct_texts(df, column)
    scored = label_texts(texts, scorer, labels)
    counts = texts
    if keep:
        scored = counts = save_stage(scored, "labels")
    return _join_labels(df, column, scored, counts, spread_by, label, rows_per_split)


def score_with_model(
    df: DataFrame,
    column: str,
    model: Transformer,
    labels: Sequence[str],
    *,
    spread_by: Sequence[str],
    text_input: str = "text",
    prediction: str = "prediction",
    label: str = "sentiment",
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """As score_text, with a fitted Spark ML model that predicts a class index."""
    check_labels(labels)
    texts = distinct_texts(df, column)
    named = texts.withColumn(text_input, F.col("text"))
    scored = model.transform(named).select(
        "text_key", "n_rows", label_at(F.col(prediction).cast("int"), labels).alias("label")
    )
    return _join_labels(df, column, scored, texts, spread_by, label, rows_per_split)
