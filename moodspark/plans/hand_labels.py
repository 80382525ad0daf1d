"""Predictions for hand labelling, and the figures once the labels are there."""

from pyspark.sql import DataFrame

from moodspark import fixed_values as fv
from moodspark.functions.relevance import filter_relevant
from moodspark.operators.evaluate import classification_report, confusion_matrix, macro_f1
from moodspark.operators.frames import (
    drop_unlabelled,
    fill_labels,
    namespaced_key,
    tag_source,
)
from moodspark.operators.sampling import first_rows
from moodspark.operators.scoring import score_lexicon
from moodspark.plans.analyse import Label, label_comments


def predictions(
    posts: DataFrame, label: Label = score_lexicon, keywords=fv.KEYWORDS, mode: str = "substring"
) -> DataFrame:
    """article_id, source, comment, clean_comment, sentiment of comments on relevant posts."""
    kept = tag_source(filter_relevant(posts, "post_caption", keywords, mode), fv.SOURCE_POSTS)
    keyed = kept.withColumn("article_id", namespaced_key("id", fv.POST_KEY_PREFIX, prefix=True))
    return label_comments(keyed, label).select(
        "article_id", "source", "comment", "clean_comment", "sentiment"
    )


def evaluate(
    labelled: DataFrame, order: list[str], rows: int | None = None, fill: bool = False
) -> dict[str, DataFrame]:
    """Matrix, report and macro F1.  Rows without a label are dropped first, or filled."""
    columns = ["true_sentiment", "sentiment"]
    head = first_rows(labelled, order, rows) if rows else labelled
    clean = fill_labels(head, columns) if fill else drop_unlabelled(head, columns)
    return {
        "matrix": confusion_matrix(clean),
        "report": classification_report(clean),
        "macro_f1": macro_f1(clean),
    }
