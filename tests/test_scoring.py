import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import functions as F

from moodspark.functions.lexicon import DEFAULT_LEXICON, MAX_LEXICON_WORDS, lexicon_label, lexicon_score
from moodspark.operators import scoring
from tests.conftest import rows

TEXTS = ["good good bad", "bad", "ordinary", "", "  \n", None, "Хорошо, СПАСИБО!", "zo'r edi", "goodness", "bad good"]


def test_lexicon(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(lexicon_label(F.col("s"))).collect()]
    assert got == [
        "positive", "negative", "neutral", "neutral", "neutral", "neutral", "positive", "positive", "neutral", "neutral",
    ]
    weights = {"a": 5, "b": -2, "c": 1}
    got = df.limit(1).select(lexicon_score(F.lit("a b b c A x"), weights)).collect()[0][0]
    assert got == 5 - 2 - 2 + 1 + 5


def test_lexicon_size_is_checked():
    with pytest.raises(ValueError):
        lexicon_score(F.lit(""), {f"w{n}": 1 for n in range(MAX_LEXICON_WORDS + 1)})
    with pytest.raises(ValueError):
        lexicon_score(F.lit(""), {})
    assert all(w == w.lower() for w in DEFAULT_LEXICON)


def counting_scorer(seen):
    """By length; notes every text it is given."""

    def make():
        def score(batch):
            with open(seen, "a") as f:
                for text in batch:
                    f.write(text.replace("\n", " ") + "\n")
            return [len(text) % 3 for text in batch]

        return score

    return make


@pytest.mark.parametrize("per_split", [3, 1_000_000])
def test_each_text_is_scored_once(spark, tmp_path, per_split):
    data = [(n, "same text") for n in range(40)] + [(100, "other"), (101, ""), (102, None), (103, " "), (104, "x" * 70_000)]
    df = spark.createDataFrame(data, "id int, s string").repartition(6)
    seen = tmp_path / "seen"
    got = scoring.score_text(
        df, "s", counting_scorer(str(seen)), ["neutral", "positive", "negative"],
        spread_by=["id"], keep=True, rows_per_split=per_split,
    )
    expected = {
        n: "neutral" if not (s or "").strip() else ["neutral", "positive", "negative"][len(s) % 3]
        for n, s in data
    }
    assert got.columns == ["id", "s", "sentiment"]
    for _ in range(2):  # the second use reads the labels that were kept
        assert {r[0]: r[2] for r in rows(got)} == expected
    lines = seen.read_text().splitlines()
    assert sorted(lines) == sorted(["same text", "other", "x" * 70_000])


def test_unknown_labels_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    with pytest.raises(ValueError):
        scoring.score_text(df, "s", None, ["good", "bad"], spread_by=["id"])


def test_fitted_model(spark):
    data = [("good day", 2.0), ("good thing", 2.0), ("bad day", 0.0), ("bad thing", 0.0), ("day", 1.0), ("thing", 1.0)]
    training = spark.createDataFrame(data * 4, "text string, label double")
    model = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}]+"),
        HashingTF(inputCol="words", outputCol="features", numFeatures=64),
        LogisticRegression(maxIter=50),
    ]).fit(training)
    df = spark.createDataFrame([(1, "good day"), (2, "bad thing"), (3, ""), (4, "good day")], "id int, s string")
    got = scoring.score_with_model(df, "s", model, ["negative", "neutral", "positive"], spread_by=["id"])
    assert rows(got.select("id", "sentiment")) == [(1, "positive"), (2, "negative"), (3, "neutral"), (4, "positive")]


def test_a_large_lexicon_is_a_table(spark):
    """Same labels as the lexicon in the plan, with 200,000 words beside its own."""
    words = {"good": 2, "bad": -1, "best": 3, "shame": -3, "zo'r": 1}
    texts = [*TEXTS, "good " * 2000, *["bad word"] * 300, "shame best", "BEST shame shame"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    table = spark.createDataFrame(list(words.items()), "word string, weight int").unionByName(
        spark.range(200_000).selectExpr("concat('other', id) AS word", "CAST(id % 7 - 3 AS INT) AS weight")
    )
    got = scoring.score_lexicon_table(df, "s", table, ["i"])
    assert got.columns == ["i", "s", "sentiment"]
    assert rows(got) == rows(scoring.score_lexicon(df, "s", words))
