"""Stored pages -> article, comment and reaction tables of one outlet."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.operators.frames import drop_noise
from moodspark.sources.keyed import (
    first_per_key,
    insert_missing,
    last_per_key,
    replace_children,
    with_key,
)
from moodspark.sources.pages import ArticleRule, CommentRule, PageRules, ReactionRule, extract_pages
from moodspark.sources.tables import save_stage


@dataclass(frozen=True)
class OutletTables:
    articles: DataFrame
    comments: DataFrame
    reactions: DataFrame | None = None


def _children(latest: DataFrame, records: str, parts: list[str]) -> DataFrame:
    exploded = latest.select("url", F.inline(records))
    # a child is known by its place on the page, so a second run gives the same ids
    return (
        with_key(exploded, "url", "article_id")
        .withColumn("id", F.md5(F.concat_ws("#", "url", *parts)))
        .drop("url", *parts)
    )


def collect_outlet(
    pages: DataFrame,
    articles: ArticleRule,
    comments: CommentRule,
    reactions: ReactionRule | None = None,
    text_only: bool = False,
) -> OutletTables:
    """Tables of one outlet.  Of several pages with one url the first (by page_id) counts
    for the article; children come from the last one, as a later visit replaces them.

    Every page is read once, for all rules, and reduced to what is wanted of it before pages of one
    url are compared, so no HTML is shuffled.  What is read is written before it is used thrice.
    """
    rules = PageRules(article=articles, comments=comments, text_only=text_only, reactions=reactions)
    read = save_stage(extract_pages(pages, rules), "pages-read")
    found = first_per_key(read.select("page_id", "url", "title", "content"), ["url"], ["page_id"])
    kinds = ["comments"] if reactions is None else ["comments", "reactions"]
    last = last_per_key(read.select("page_id", "url", *kinds), ["url"], ["page_id"])
    return OutletTables(
        articles=with_key(found, "url").select("id", "url", "title", "content"),
        comments=_children(last, "comments", ["position", "part"] if text_only else ["position"]),
        reactions=None if reactions is None else _children(last, "reactions", ["position"]),
    )


def collect_posts(
    pages: DataFrame, article: ArticleRule, comments: CommentRule, account: str
) -> DataFrame:
    """Post comments with the caption on every row, noise dropped.

    Of several visits to one post the last one (by page_id) counts.
    """
    read = extract_pages(pages, PageRules(article=article, comments=comments))
    last = last_per_key(read, ["url"], ["page_id"])
    said = last.select(
        F.col("url").alias("post_url"), F.col("title").alias("post_caption"), F.inline("comments")
    )
    return drop_noise(said, "comment").select(
        F.md5(F.concat_ws("#", "post_url", "position")).alias("id"),
        F.lit(account).alias("account_name"),
        "post_url",
        "post_caption",
        "comment",
    )


def refresh(old: OutletTables, new: OutletTables) -> OutletTables:
    """Known articles stay as they are, new ones are added; children of every visited
    article are replaced."""
    visited = new.articles.select(F.col("id").alias("article_id"))
    reactions = old.reactions
    if new.reactions is not None and old.reactions is not None:
        reactions = replace_children(
            old.reactions, new.reactions, visited, ["article_id"], spread_by=["id"]
        )
    return OutletTables(
        articles=insert_missing(old.articles, new.articles, ["url"], ["id"]),
        comments=replace_children(
            old.comments, new.comments, visited, ["article_id"], spread_by=["id"]
        ),
        reactions=reactions,
    )
