"""Projections, filters, joins, stacking, samples."""

import re

from pyspark.sql import functions as F

from moodspark.catalog import query
from moodspark.catalog import inputs as i
from moodspark.fixed_values import KEYWORDS
from moodspark.functions.relevance import filter_relevant, relevance_counts
from moodspark.functions.text import SPACE_CHARS, WORD_CHARS, is_mention_only, is_short, is_symbol_only
from moodspark.operators import frames, sampling
from moodspark.operators.mood import attach_mood, comment_mood, map_reaction, override_mood, reaction_mood
from moodspark.operators.prompts import fetch_comments, with_comments


@query("""SELECT doc_id, 'web' AS source, CAST(doc_id AS VARCHAR) || 'web' AS article_id,
                 'insta_' || CAST(doc_id AS VARCHAR) AS post_id
          FROM documents""")
def tagged_keys(spark, sf):
    docs = frames.tag_source(i.table(spark, sf, "documents").select("doc_id"), "web")
    return docs.select(
        "doc_id",
        "source",
        frames.namespaced_key("doc_id", F.col("source")).alias("article_id"),
        frames.namespaced_key("doc_id", "insta_", prefix=True).alias("post_id"),
    )


@query("SELECT doc_id AS article_id, source, text FROM documents")
def normalised_articles(spark, sf):
    return frames.normalise_article(i.articles(spark, sf), ["article_id", "source", "text"])


def _sql_contains(keywords):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tests = []
    for k in keywords:
        k = k.replace("'", "''")
        tests.append(
            f"contains(translate(text, '{upper}', '{lower}'), translate('{k}', '{upper}', '{lower}'))"
        )
    return "(" + " OR ".join(tests) + ")"


@query(f"SELECT doc_id, text FROM documents WHERE text IS NULL OR {_sql_contains(i.TEST_KEYWORDS)}")
def relevant_documents(spark, sf):
    docs = i.table(spark, sf, "documents").select("doc_id", "text")
    return filter_relevant(docs, "text", i.TEST_KEYWORDS)


@query(f"SELECT doc_id FROM documents WHERE text IS NULL OR {_sql_contains(KEYWORDS)}")
def relevant_documents_default_topics(spark, sf):
    docs = i.table(spark, sf, "documents").select("doc_id", "text")
    return filter_relevant(docs, "text").select("doc_id")


_WORDS = "|".join(re.escape(w) for w in i.TEST_WORDS)


@query(rf"""SELECT doc_id FROM documents
            WHERE text IS NULL
               OR regexp_matches(text, '(?i)(?:\A|[^{WORD_CHARS}])(?:{_WORDS})(?:[^{WORD_CHARS}]|\z)')""")
def relevant_documents_whole_words(spark, sf):
    docs = i.table(spark, sf, "documents").select("doc_id", "text")
    return filter_relevant(docs, "text", i.TEST_WORDS, mode="word").select("doc_id")


@query(f"""SELECT CAST(count(*) AS BIGINT) AS total_rows,
                  CAST(count(*) FILTER (keep) AS BIGINT) AS kept_rows,
                  CAST(count(*) FILTER (NOT keep) AS BIGINT) AS deleted_rows
           FROM (SELECT text IS NULL OR {_sql_contains(i.TEST_KEYWORDS)} AS keep FROM documents)""")
def relevance_delete_counts(spark, sf):
    return relevance_counts(i.table(spark, sf, "documents"), "text", i.TEST_KEYWORDS)


_SQL_SYMBOL = f"NOT regexp_matches(text, '[{WORD_CHARS}]')"
_SQL_SHORT = "length(text) <= 12"
_SQL_MENTION = rf"regexp_matches(text, '\A[{SPACE_CHARS}]*(?:@[{WORD_CHARS}]+[{SPACE_CHARS}]*)+\z')"


@query(f"""SELECT doc_id, {_SQL_SYMBOL} AS symbol_only, {_SQL_SHORT} AS short,
                  {_SQL_MENTION} AS mention_only
           FROM documents""")
def noise_flags(spark, sf):
    return i.table(spark, sf, "documents").select(
        "doc_id",
        is_symbol_only("text").alias("symbol_only"),
        is_short("text").alias("short"),
        is_mention_only("text").alias("mention_only"),
    )


@query(f"""SELECT doc_id, {i.sql_strip('text')} AS text FROM documents
           WHERE NOT ({_SQL_SHORT} OR {_SQL_SYMBOL} OR {_SQL_MENTION})""")
def documents_without_noise(spark, sf):
    return frames.drop_noise(i.table(spark, sf, "documents").select("doc_id", "text"), "text")


@query(f"SELECT doc_id, source FROM documents WHERE NOT {i.sql_blank('text')}")
def documents_with_text(spark, sf):
    return frames.where_text(i.table(spark, sf, "documents"), "text").select("doc_id", "source")


_SQL_TRUTH = """SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS truth
                FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def _truth(spark, sf):
    labels = i.table(spark, sf, "labels").select("doc_id", "quality")
    truth = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative")
    return (
        i.table(spark, sf, "documents")
        .select("doc_id")
        .join(labels, "doc_id", "left")
        .select("doc_id", truth.alias("truth"))
    )


@query(f"SELECT * FROM ({_SQL_TRUTH}) WHERE truth IS NOT NULL")
def rows_with_value(spark, sf):
    return frames.where_not_null(_truth(spark, sf), "truth")


@query(f"SELECT * FROM ({_SQL_TRUTH}) WHERE truth IS NOT NULL AND doc_id IS NOT NULL")
def labelled_rows_only(spark, sf):
    return frames.drop_unlabelled(_truth(spark, sf), ["truth", "doc_id"])


@query(f"SELECT doc_id, coalesce(truth, 'neutral') AS truth FROM ({_SQL_TRUTH})")
def labels_filled(spark, sf):
    return frames.fill_labels(_truth(spark, sf), ["truth"])


@query(f"""SELECT d.doc_id AS article_id, d.source, c.mood FROM documents d
           LEFT JOIN ({i.SQL_COMMENT_MOOD}) c ON c.article_id = d.doc_id""")
def articles_with_comment_mood(spark, sf):
    moods = comment_mood(i.labelled(spark, sf), "article_id")
    return attach_mood(i.articles(spark, sf).select("article_id", "source"), moods)


@query(f"""SELECT d.doc_id AS article_id, d.source, coalesce(r.dominant_sentiment, c.mood) AS mood
           FROM documents d
           LEFT JOIN ({i.SQL_COMMENT_MOOD}) c ON c.article_id = d.doc_id
           LEFT JOIN ({i.SQL_REACTION_MOOD}) r ON r.article_id = d.doc_id""")
def articles_with_reaction_override(spark, sf):
    dominant = reaction_mood(i.reactions(spark, sf), "article_id", i.TEST_REACTIONS)
    return override_mood(articles_with_comment_mood(spark, sf), dominant)


@query("""SELECT doc_id AS article_id, source FROM documents d
          WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.role = 'user' AND c.conv_id = d.doc_id)""")
def articles_with_comments(spark, sf):
    kept = with_comments(i.articles(spark, sf), i.comments(spark, sf), ["article_id"])
    return kept.select("article_id", "source")


@query(f"""
    WITH c AS (SELECT conv_id, turn, text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
               FROM conversations WHERE role = 'user' AND text IS NOT NULL),
         l AS (SELECT conv_id, string_agg({i.sql_clean('text')}, chr(10) ORDER BY turn) AS comments,
                      count(*) AS n
               FROM c WHERE rn <= 5 GROUP BY conv_id)
    SELECT d.doc_id AS article_id, coalesce(l.comments, '') AS comments,
           CAST(coalesce(l.n, 0) AS BIGINT) AS n_comments
    FROM documents d LEFT JOIN l ON l.conv_id = d.doc_id""")
def article_comment_lists(spark, sf):
    found = fetch_comments(
        i.articles(spark, sf).select("article_id"), i.comments(spark, sf), ["article_id"]
    )
    return found.select(
        "article_id",
        F.array_join("comments", "\n").alias("comments"),
        F.size("comments").cast("bigint").alias("n_comments"),
    )


@query(f"SELECT event_id, event_type, {i.sql_reaction('event_type')} AS label FROM events")
def reaction_labels(spark, sf):
    return i.table(spark, sf, "events").select(
        "event_id", "event_type", map_reaction("event_type", i.TEST_REACTIONS).alias("label")
    )


@query("""SELECT doc_id AS article_id, source, text AS content, NULL::BIGINT AS id,
                 NULL::VARCHAR AS comment FROM documents
          UNION ALL BY NAME
          SELECT conv_id AS article_id, NULL::VARCHAR AS source, NULL::VARCHAR AS content, turn AS id,
                 text AS comment FROM conversations WHERE role = 'user'""")
def stacked_frames(spark, sf):
    return frames.stack(i.articles(spark, sf), i.comments(spark, sf))


@query("SELECT DISTINCT user_id FROM events")
def distinct_parents(spark, sf):
    return frames.distinct_values(i.table(spark, sf, "events"), "user_id")


@query("""SELECT event_id, user_id, event_type FROM
            (SELECT *, row_number() OVER (PARTITION BY user_id
                ORDER BY md5('42:' || CAST(event_id AS VARCHAR)), event_id) AS rn FROM events)
          WHERE rn <= 50""")
def sample_per_post(spark, sf):
    events = i.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return sampling.sample_per_group(events, ["user_id"], ["event_id"])


@query("""SELECT conv_id, turn, text FROM conversations
          ORDER BY md5('42:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), conv_id, turn
          LIMIT 10""")
def sample_of_comments(spark, sf):
    turns = i.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return sampling.sample_rows(turns, ["conv_id", "turn"])


@query("""SELECT doc_id, source, md5('42:' || CAST(doc_id AS VARCHAR)) AS place FROM documents
          ORDER BY place, doc_id LIMIT 5""")
def shuffled_head_of_documents(spark, sf):
    return sampling.shuffled_head(i.table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"])


@query("""SELECT event_id, user_id, event_type FROM
            (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
          WHERE rn <= 5""")
def first_comments_per_article(spark, sf):
    events = i.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return sampling.first_comments(events, ["user_id"], ["event_id"])
