"""Summaries of articles and posts.

The instructions that go with the prompts are ARTICLE_SYSTEM_TEXT and POST_SYSTEM_TEXT in
fixed_values; the caller's function passes them on if its model takes any.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame

from moodspark.fixed_values import POST_ERROR_TEXT
from moodspark.functions.text import first_sentences
from moodspark.operators.frames import normalise_article, where_text
from moodspark.operators.prompts import (
    article_prompts,
    fetch_comments,
    generate,
    post_groups,
    post_prompts,
    with_comments,
)

MakeText = Callable[[], Callable[[str], str]]


def summarise_articles(
    articles: DataFrame,
    comments: DataFrame,
    make: MakeText | None = None,
    parallel_calls: int | None = None,
    redact: bool = True,
) -> DataFrame:
    """source, article_id, title, summary for articles with text and at least one comment.

    Keyed by (source, article_id).  Without ``make`` the summary is the text's first sentences.
    """
    texts = where_text(normalise_article(articles), "text")
    commented = with_comments(texts, comments)
    columns = ["source", "article_id", "title", "summary"]
    if make is None:
        return commented.withColumn("summary", first_sentences("text")).select(columns)
    prompts = article_prompts(
        fetch_comments(commented, comments, redact=redact), redact=redact
    ).select(
        "source", "article_id", "title", "prompt"
    )
    return generate(prompts, make, parallel_calls=parallel_calls, key="article_id").select(columns)


def summarise_posts(
    comments: DataFrame,
    make: MakeText | None = None,
    parallel_calls: int | None = None,
    redact: bool = True,
) -> DataFrame:
    """post_url, caption, comment_count, summary.  Without ``make`` the first sentences of
    the caption."""
    groups = post_groups(comments, redact=redact)
    columns = ["post_url", "caption", "comment_count", "summary"]
    if make is None:
        return groups.withColumn("summary", first_sentences("caption")).select(columns)
    return generate(
        post_prompts(groups, redact),
        lambda: _trimmed(make()),
        error=lambda reason: POST_ERROR_TEXT,
        parallel_calls=parallel_calls,
        key="post_url",
    ).select(columns)


def _trimmed(call: Callable[[str], str]) -> Callable[[str], str]:
    return lambda text: call(text).strip()
