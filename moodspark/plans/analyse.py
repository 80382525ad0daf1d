"""Tables of several outlets -> labels, moods and the report input."""

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark import fixed_values as fv
from moodspark import schemas
from moodspark.functions.relevance import filter_relevant
from moodspark.functions.text import clean_text
from moodspark.operators.frames import namespaced_key, stack, tag_source
from moodspark.operators.mood import (
    article_moods,
    comment_mood,
    label_counts,
    majority_label,
    majority_of_counts,
    mood_distribution,
    reaction_mood,
)
from moodspark.operators.prompts import report_lines
from moodspark.operators.sampling import first_captions
from moodspark.operators.scoring import score_lexicon
from moodspark.sources.tables import (
    overwrite,
    read_table,
    save_stage,
    table_exists,
    write_report_input,
)

Label = Callable[[DataFrame, str], DataFrame]  # adds ``sentiment`` for the named column


@dataclass(frozen=True)
class Frames:
    """articles(article_id, source, ...), comments(article_id, id, source, comment),
    reactions(article_id, emotion, count), posts(as stored, relevant ones only)."""

    articles: DataFrame
    comments: DataFrame
    reactions: DataFrame
    posts: DataFrame


def keyed_articles(articles: DataFrame, source: str) -> DataFrame:
    return tag_source(articles, source).withColumn("article_id", namespaced_key("id", source))


def keyed_children(children: DataFrame, source: str) -> DataFrame:
    return tag_source(children, source).withColumn(
        "article_id", namespaced_key("article_id", source)
    )


def load_frames(
    spark: SparkSession,
    root: str,
    keywords=fv.KEYWORDS,
    mode: str = "substring",
    key_type: str = "string",
) -> Frames:
    """Read the outlets' tables below ``root`` and bring them to one form.

    The post table may be absent; off-topic posts are left out, not deleted.  Tables made
    by ``collect`` have text keys; ``key_type="bigint"`` reads numbered ones.
    """

    def table(outlet: str, name: str, schema: str, missing: str = "error") -> DataFrame:
        typed = schemas.keyed_by(schema, key_type)
        return read_table(spark, os.path.join(root, outlet, name), typed, missing)

    voted, plain = fv.SOURCE_VOTED, fv.SOURCE_REACTIONS
    columns = ["article_id", "id", "source", "comment"]
    posts = filter_relevant(
        table(fv.SOURCE_POSTS, "comments", schemas.POST_COMMENTS, "empty"),
        "post_caption", keywords, mode,
    )
    return Frames(
        articles=stack(
            keyed_articles(table(voted, "articles", schemas.ARTICLES), voted),
            keyed_articles(table(plain, "articles", schemas.ARTICLES), plain),
        ),
        comments=stack(
            keyed_children(table(voted, "comments", schemas.COMMENTS_VOTED), voted).select(columns),
            keyed_children(table(plain, "comments", schemas.COMMENTS_PLAIN), plain).select(columns),
        ),
        reactions=keyed_children(table(plain, "reactions", schemas.REACTIONS), plain).select(
            "article_id", "emotion", "count"
        ),
        posts=posts,
    )


def stored_summaries(
    spark: SparkSession, root: str
) -> tuple[DataFrame | None, DataFrame | None]:
    """Summaries of posts and of articles, None for a table that is not there."""

    def table(name: str, schema: str) -> DataFrame | None:
        path = os.path.join(root, name)
        return read_table(spark, path, schema) if table_exists(spark, path) else None

    return (
        table("post_summaries", schemas.POST_SUMMARIES),
        table("article_summaries", schemas.keyed_by(schemas.ARTICLE_SUMMARIES, "string")),
    )


def label_comments(comments: DataFrame, label: Label = score_lexicon) -> DataFrame:
    """Adds clean_comment and its sentiment."""
    return label(comments.withColumn("clean_comment", clean_text("comment")), "clean_comment")


def label_posts(posts: DataFrame, label: Label = score_lexicon) -> DataFrame:
    """Adds the sentiment of the comment as written."""
    return label(posts, "comment")


def post_reactions(
    labelled: DataFrame, key: str = "post_url", ties: Sequence[str] = tuple(sorted(fv.LABELS))
) -> DataFrame:
    """Majority label per post with its caption; ``key='post_caption'`` groups by caption."""
    if key == "post_caption":
        return majority_label(labelled, key, ties=ties)
    known = labelled.where(F.col(key).isNotNull())
    counted = first_captions(known, label_counts(), key)
    return majority_of_counts(counted, ties).select(key, "average_sentiment", "post_caption")


def post_moods(labelled: DataFrame) -> DataFrame:
    """Posts in the same terms as articles: key = post_url, mood by plurality."""
    known = labelled.where(F.col("post_url").isNotNull())
    return comment_mood(known, "post_url").select(
        F.col("post_url").alias("article_id"), F.lit(fv.SOURCE_POSTS).alias("source"), "mood"
    )


def mood_by_source(moods: DataFrame) -> DataFrame:
    return mood_distribution(moods, "source")


def analyse(
    frames: Frames,
    label: Label = score_lexicon,
    labels: Mapping[str, str] = fv.REACTION_LABELS,
    post_summaries: DataFrame | None = None,
    article_summaries: DataFrame | None = None,
    keep: bool = True,
) -> dict[str, DataFrame]:
    """All results of a run: articles, comments, reactions, posts, post_moods, sources, report.

    Posts are in the run in the same terms as articles: ``post_moods`` has a mood for each, by its
    comments, and ``sources`` the moods of all outlets, posts among them.  Post comments are labelled once
    as they were written, for the reaction to a post, and once cleaned, for its mood.  With ``keep`` the labelled comments and the moods are written once and read from there
    by everything after, so no text is labelled twice.
    """
    save = save_stage if keep else (lambda df, name: df)
    comments = save(label_comments(frames.comments, label), "comments")
    posts = save(label_posts(frames.posts, label), "posts")
    cleaned = frames.posts.select("id", "post_url", "comment")
    moods_of_posts = save(post_moods(label_comments(cleaned, label)), "post-moods")
    dominant = save(reaction_mood(frames.reactions, "article_id", labels), "reactions")
    articles = save(
        article_moods(frames.articles, comments, frames.reactions, labels), "articles"
    )
    reacted = post_reactions(posts)
    quoted = stack(
        comments.select("article_id", F.col("id").cast("string").alias("id"), "clean_comment"),
        posts.select(
            namespaced_key("id", fv.POST_KEY_PREFIX, prefix=True).alias("article_id"),
            F.col("id").cast("string").alias("id"),
            clean_text("comment").alias("clean_comment"),
        ),
    )
    shown = reacted.withColumn("post_caption", clean_text("post_caption"))
    return {
        "articles": articles,
        "comments": comments,
        "reactions": dominant,
        "posts": reacted,
        "post_moods": moods_of_posts,
        "sources": mood_by_source(
            stack(articles.select("source", "mood"), moods_of_posts.select("source", "mood"))
        ),
        "report": report_lines(
            articles, dominant, quoted, shown, post_summaries, article_summaries
        ),
    }


def write_results(results: Mapping[str, DataFrame], root: str) -> None:
    """Replace the tables of the last run, and the report input beside them."""
    for name in ("articles", "comments", "reactions", "posts", "post_moods", "sources"):
        overwrite(results[name], os.path.join(root, name))
    write_report_input(results["report"], os.path.join(root, "report"))
