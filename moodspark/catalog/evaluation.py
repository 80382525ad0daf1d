"""Predictions against labels, and column profiles."""

from pyspark.sql import functions as F

from moodspark.catalog import inputs as i
from moodspark.catalog import query
from moodspark.catalog.rows import _sql_contains
from moodspark.fixed_values import EVALUATION_LABELS, EVALUATION_ROWS
from moodspark.operators import evaluate, frames
from moodspark.operators.scoring import score_lexicon
from moodspark.plans import hand_labels

_SQL_PAIRS = f"""
    SELECT l.doc_id, CASE l.quality WHEN 1 THEN 'positive' ELSE 'negative' END AS true_sentiment,
           {i.sql_label('d.text')} AS sentiment
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""


def _pairs(spark, sf):
    truth = i.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("true_sentiment")
    )
    docs = i.table(spark, sf, "documents").select("doc_id", "text")
    joined = truth.join(docs, "doc_id")
    return score_lexicon(joined, "text", i.TEST_LEXICON).drop("text")


_SQL_NAMES = ", ".join(f"({n}, '{x}')" for n, x in enumerate(EVALUATION_LABELS))


def _sql_matrix(pairs):
    return f"""
    SELECT t.x AS truth, q.x AS predicted, CAST(count(p.doc_id) AS BIGINT) AS n
    FROM (VALUES {_SQL_NAMES}) t(k, x) JOIN (VALUES {_SQL_NAMES}) q(k, x) ON true
    LEFT JOIN ({pairs}) p ON p.true_sentiment = t.x AND p.sentiment = q.x
    GROUP BY t.x, q.x"""


def _sql_scores(pairs):
    return f"""
    WITH m AS ({_sql_matrix(pairs)}),
         c AS (SELECT l.k, l.x AS label,
                      CAST(sum(n) FILTER (truth = l.x AND predicted = l.x) AS BIGINT) AS hits,
                      CAST(sum(n) FILTER (truth = l.x) AS BIGINT) AS support,
                      CAST(sum(n) FILTER (predicted = l.x) AS BIGINT) AS guesses
               FROM m JOIN (VALUES {_SQL_NAMES}) l(k, x) ON true GROUP BY l.k, l.x),
         r AS (SELECT *, CASE WHEN guesses = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / guesses::DOUBLE END AS precision,
                      CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / support::DOUBLE END AS recall
               FROM c WHERE support + guesses > 0),
         s AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE
                              ELSE 2.0::DOUBLE * precision * recall / (precision + recall) END AS f1 FROM r)"""


def _sql_sum(expression):
    return f"list_sum(list({expression} ORDER BY k))"


def _sql_report(pairs):
    return f"""{_sql_scores(pairs)}
    SELECT label, precision, recall, f1, support FROM s
    UNION ALL SELECT 'accuracy', NULL, NULL, sum(hits)::DOUBLE / sum(support)::DOUBLE, CAST(sum(support) AS BIGINT) FROM s
    UNION ALL SELECT 'macro avg', {_sql_sum('precision')} / count(*)::DOUBLE, {_sql_sum('recall')} / count(*)::DOUBLE,
                     {_sql_sum('f1')} / count(*)::DOUBLE, CAST(sum(support) AS BIGINT) FROM s
    UNION ALL SELECT 'weighted avg', {_sql_sum('precision * support')} / sum(support)::DOUBLE,
                     {_sql_sum('recall * support')} / sum(support)::DOUBLE,
                     {_sql_sum('f1 * support')} / sum(support)::DOUBLE, CAST(sum(support) AS BIGINT) FROM s"""


@query(_sql_matrix(_SQL_PAIRS))
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_pairs(spark, sf))


@query(_sql_report(_SQL_PAIRS))
def classification_report(spark, sf):
    return evaluate.classification_report(_pairs(spark, sf))


@query(f"{_sql_scores(_SQL_PAIRS)} SELECT {_sql_sum('f1')} / count(*)::DOUBLE AS macro_f1 FROM s")
def macro_f1(spark, sf):
    return evaluate.macro_f1(_pairs(spark, sf))


@query(_sql_report(f"SELECT * FROM ({_SQL_PAIRS}) ORDER BY doc_id LIMIT 50"))
def report_on_first_rows(spark, sf):
    return hand_labels.evaluate(_pairs(spark, sf), ["doc_id"], rows=EVALUATION_ROWS)["report"]


@query(f"""SELECT 'insta_' || CAST(id AS VARCHAR) AS article_id, 'instagram' AS source, comment,
                  {i.sql_clean('comment')} AS clean_comment,
                  {i.sql_label(i.sql_clean('comment'))} AS sentiment
           FROM (SELECT id, comment, post_caption AS text FROM ({i.SQL_POSTS}))
           WHERE text IS NULL OR {_sql_contains(i.TEST_KEYWORDS)}""")
def predictions_for_hand_labels(spark, sf):
    return hand_labels.predictions(
        i.posts(spark, sf),
        lambda df, column: score_lexicon(df, column, i.TEST_LEXICON),
        i.TEST_KEYWORDS,
    )


_PROFILED = {"doc_id": "bigint", "lang": "string", "truth": "string", "toxic": "int"}
_SQL_PROFILED = """
    SELECT d.doc_id, d.lang, CASE l.quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS truth, l.toxic
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{t}' AS data_type, CAST(count(*) AS BIGINT) AS n_rows,
               CAST(count({c}) AS BIGINT) AS non_null, CAST(count(*) - count({c}) AS BIGINT) AS nulls
        FROM ({_SQL_PROFILED})"""
    for c, t in _PROFILED.items()
))
def column_profile(spark, sf):
    labels = i.table(spark, sf, "labels")
    truth = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative")
    joined = i.table(spark, sf, "documents").join(labels, "doc_id", "left")
    return frames.column_profile(joined.select("doc_id", "lang", truth.alias("truth"), "toxic"))
