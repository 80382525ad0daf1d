import pytest
from pyspark.sql import functions as F

from moodspark.fixed_values import LABELS, REACTION_LABELS
from moodspark.operators import mood
from tests.conftest import rows


def labelled(spark, groups):
    data = [(a, label) for a, labels in groups.items() for label in labels]
    return spark.createDataFrame(data, "article_id string, sentiment string")


def test_strict_plurality(spark):
    groups = {
        "two": ["positive", "negative"], "three": list(LABELS), "one": ["negative"],
        "pos": ["positive", "positive", "negative", "neutral"],
        "posneu": ["positive", "positive", "neutral", "neutral", "negative"],
        "unlabelled": [None],
    }
    got = {r[0]: r[1:] for r in rows(mood.comment_mood(labelled(spark, groups), "article_id"))}
    assert got == {
        "two": (1, 0, 1, "neutral"), "three": (1, 1, 1, "neutral"), "one": (1, 0, 0, "negative"),
        "pos": (1, 1, 2, "positive"), "posneu": (1, 2, 2, "neutral"),
        "unlabelled": (0, 0, 0, "neutral"),
    }


def test_class_missing_from_the_table(spark):
    got = rows(mood.count_labels(labelled(spark, {"a": ["positive"]}), "article_id"))
    assert got == [("a", 0, 0, 1)]


REACTIONS = [
    ("unmapped", "Шок", 9), ("zero", "Грусть", 0), ("zero", "Радость", 0),
    ("tie", "Нравится", 3), ("tie", "Грусть", 3), ("neu", "Удивление", 4), ("neu", "Не нравится", 4),
    ("null", "Грусть", None), ("null", "Удивление", 1), ("neg", "Грусть", 2), ("neg", "Разочарование", 2),
    ("neg", "Радость", 3), ("stranger", "Радость", 1), ("neg", None, 100),
]


def test_dominant_reaction(spark):
    df = spark.createDataFrame(REACTIONS, "article_id string, emotion string, count bigint")
    got = {r[0]: r[1:] for r in rows(mood.reaction_mood(df, "article_id"))}
    assert got == {
        "zero": (0, 0, 0, "positive"), "tie": (3, 0, 3, "positive"), "neu": (4, 4, 0, "neutral"),
        "null": (0, 1, 0, "neutral"), "neg": (4, 0, 3, "negative"),
        "stranger": (0, 0, 1, "positive"),
    }


def test_map_reaction_covers_every_name(spark):
    df = spark.createDataFrame([(n,) for n in REACTION_LABELS], "name string")
    got = dict(rows(df.select("name", mood.map_reaction("name"))))
    assert got == REACTION_LABELS


def test_article_moods(spark):
    names = ["both", "comments", "none", "unmapped", "zero"]
    articles = spark.createDataFrame([(n,) for n in names], "article_id string")
    comments = labelled(spark, {"both": ["negative"], "comments": ["negative"], "unmapped": ["neutral"], "lost": ["positive"]})
    reactions = spark.createDataFrame(
        [("both", "Радость", 1), ("unmapped", "Шок", 5), ("zero", "Грусть", 0), ("lost", "Грусть", 1)],
        "article_id string, emotion string, count bigint",
    )
    got = dict(rows(mood.article_moods(articles, comments, reactions)))
    assert got == {
        "both": "positive", "comments": "negative", "none": "no comment", "unmapped": "neutral",
        "zero": "positive",
    }
    shares = {r[0]: r[1:] for r in rows(mood.mood_distribution(mood.article_moods(articles, comments, reactions)))}
    assert shares == {
        "positive": (2, 0.4), "negative": (1, 0.2), "neutral": (1, 0.2), "no comment": (1, 0.2),
    }


def test_distribution_of_nothing(spark):
    got = rows(mood.mood_distribution(spark.createDataFrame([], "mood string")))
    assert got == [(m, 0, None) for m in ("negative", "neutral", "no comment", "positive")]


def test_majority(spark):
    data = [
        ("a", "positive"), ("a", "negative"), ("b", "neutral"), ("b", "positive"), ("b", "positive"),
        ("c", None), (None, "positive"), ("", "neutral"),
    ]
    df = spark.createDataFrame(data, "post_url string, sentiment string")
    expected = [("", "neutral"), ("a", "negative"), ("b", "positive")]
    for parts in (1, 7, 64):
        assert rows(mood.majority_label(df.repartition(parts))) == expected


def test_top_labels(spark):
    df = spark.createDataFrame([(x,) for x in "aabbcddddee"] + [(None,)] * 9, "label string")
    got = [tuple(r) for r in mood.top_labels(df, "label", 3).collect()]
    assert got == [("d", 4), ("a", 2), ("b", 2)]


def test_counts_are_a_single_shuffle(spark):
    df = labelled(spark, {"a": ["positive"]}).where(F.col("article_id").isNotNull())
    plan = mood.comment_mood(df, "article_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ties_of_a_majority(spark):
    df = spark.createDataFrame([("p", "negative"), ("p", "positive"), ("q", "neutral"), ("r", None)], "post_url string, sentiment string")
    assert rows(mood.majority_label(df)) == [("p", "negative"), ("q", "neutral")]
    assert rows(mood.majority_label(df, ties=["neutral", "positive", "negative"])) == [("p", "positive"), ("q", "neutral")]
    with pytest.raises(ValueError):
        mood.majority_label(df, ties=["positive"])
