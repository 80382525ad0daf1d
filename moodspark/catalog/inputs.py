"""The test tables in the roles of articles, comments, reactions and posts.

``documents`` are articles, user turns of ``conversations`` their comments and ``events``
their reactions.  For per-post work, where there should be many comments per post, events
also stand in for comments.  Each mapping has its SQL counterpart below.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.functions.text import REMOVED_PARTS, SPACE_CHARS, WORD_CHARS, clean_text
from moodspark.operators.scoring import score_lexicon
from moodspark.operators.skew import balanced_join
from moodspark.sources.tables import read_table

# words of the synthetic texts, as the real lexicon's words do not occur in them
TEST_LEXICON = {"the": 1, "le": 1, "und": 1, "of": -1, "la": -1, "der": -1}
TEST_REACTIONS = {
    "purchase": "positive", "signup": "positive", "click": "neutral", "error": "negative",
}
TEST_KEYWORDS = ["Tion", "eau", "ung ", "ción", "Über"]
TEST_WORDS = ["the", "für", "está", "été"]


# the columns used; with a schema at hand no file is opened before the query runs
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", SCHEMAS[name])


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("article_id"), "source", F.col("text").alias("content")
    )


def comments(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "conversations")
        .where("role = 'user'")
        .select(
            F.col("conv_id").alias("article_id"), F.col("turn").alias("id"),
            F.col("text").alias("comment"),
        )
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Comments with the label of their cleaned text."""
    cleaned = comments(spark, sf).withColumn("clean_comment", clean_text("comment"))
    return score_lexicon(cleaned, "clean_comment", TEST_LEXICON).drop("clean_comment")


def reactions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("article_id"),
        F.col("event_type").alias("emotion"),
        F.round("value").cast("bigint").alias("count"),
    )


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Post comments, the caption repeated on every row."""
    captions = table(spark, sf, "documents").select(
        F.col("doc_id").alias("user_id"),
        F.col("source").alias("account_name"),
        F.col("text").alias("post_caption"),
    )
    said = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    both = balanced_join(said, captions, ["user_id"], "inner", spread_by=["event_id"])
    return both.select(
        F.col("event_id").alias("id"),
        "account_name",
        F.concat(F.lit("post/"), F.col("user_id").cast("string")).alias("post_url"),
        "post_caption",
        F.concat_ws(" ", "event_type", "props").alias("comment"),
    )


# --- the same in SQL ------------------------------------------------------------


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_clean(c: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '{REMOVED_PARTS}', '', 'g'),"
        f" '[{SPACE_CHARS}]+', ' ', 'g'))"
    )


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '\\A[{SPACE_CHARS}]+|[{SPACE_CHARS}]+\\z', '', 'g')"


def sql_blank(c: str) -> str:
    return f"({c} IS NULL OR NOT regexp_matches({c}, '[^{SPACE_CHARS}]'))"


def sql_label(c: str) -> str:
    plus = ", ".join(f"'{w}'" for w, n in TEST_LEXICON.items() if n > 0)
    minus = ", ".join(f"'{w}'" for w, n in TEST_LEXICON.items() if n < 0)
    words = f"regexp_extract_all(lower(coalesce({c}, '')), '[{WORD_CHARS}]+')"
    score = (
        f"coalesce(list_sum(list_transform({words}, lambda t: CASE WHEN t IN ({plus}) THEN 1"
        f" WHEN t IN ({minus}) THEN -1 ELSE 0 END)), 0)"
    )
    return (
        f"CASE sign({score}) WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END"
    )


def sql_reaction(c: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN '{lab}'" for n, lab in TEST_REACTIONS.items())
    return f"CASE {c} {cases} END"


SQL_LABELLED = f"""
    SELECT conv_id AS article_id, turn AS id, text AS comment, {sql_label(sql_clean('text'))} AS sentiment
    FROM conversations WHERE role = 'user'"""

SQL_COUNTS = f"""
    SELECT article_id,
           CAST(count(*) FILTER (sentiment = 'negative') AS BIGINT) AS negative,
           CAST(count(*) FILTER (sentiment = 'neutral') AS BIGINT) AS neutral,
           CAST(count(*) FILTER (sentiment = 'positive') AS BIGINT) AS positive
    FROM ({SQL_LABELLED}) GROUP BY article_id"""

SQL_COMMENT_MOOD = f"""
    SELECT *, CASE WHEN positive > greatest(negative, neutral) THEN 'positive'
                   WHEN negative > greatest(positive, neutral) THEN 'negative'
                   ELSE 'neutral' END AS mood
    FROM ({SQL_COUNTS})"""

SQL_REACTION_SUMS = f"""
    SELECT user_id AS article_id,
           CAST(coalesce(sum(n) FILTER (label = 'negative'), 0) AS BIGINT) AS negative,
           CAST(coalesce(sum(n) FILTER (label = 'neutral'), 0) AS BIGINT) AS neutral,
           CAST(coalesce(sum(n) FILTER (label = 'positive'), 0) AS BIGINT) AS positive
    FROM (SELECT user_id, {sql_reaction('event_type')} AS label, CAST(round(value) AS BIGINT) AS n
          FROM events)
    WHERE label IS NOT NULL GROUP BY user_id"""

SQL_REACTION_MOOD = f"""
    SELECT *, CASE WHEN positive >= neutral AND positive >= negative THEN 'positive'
                   WHEN neutral >= negative THEN 'neutral'
                   ELSE 'negative' END AS dominant_sentiment
    FROM ({SQL_REACTION_SUMS})"""

SQL_ARTICLE_MOODS = f"""
    SELECT d.doc_id AS article_id, d.source,
           coalesce(r.dominant_sentiment, c.mood, 'no comment') AS mood
    FROM documents d
    LEFT JOIN ({SQL_COMMENT_MOOD}) c ON c.article_id = d.doc_id
    LEFT JOIN ({SQL_REACTION_MOOD}) r ON r.article_id = d.doc_id"""

SQL_POSTS = """
    SELECT e.event_id AS id, d.source AS account_name,
           'post/' || CAST(e.user_id AS VARCHAR) AS post_url, d.text AS post_caption,
           e.event_type || ' ' || e.props AS comment
    FROM events e JOIN documents d ON d.doc_id = e.user_id"""
