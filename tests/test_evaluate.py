import pytest

from moodspark.operators import evaluate, frames
from moodspark.plans import hand_labels
from tests.conftest import rows

PAIRS = [
    ("positive", "positive"), ("positive", "positive"), ("positive", "negative"),
    ("negative", "negative"), ("negative", "positive"), ("negative", "negative"), ("negative", "negative"),
]
SCHEMA = "true_sentiment string, sentiment string"


def figures(spark, pairs):
    df = spark.createDataFrame(pairs, SCHEMA)
    report = {r[0]: r[1:] for r in rows(evaluate.classification_report(df))}
    return report, evaluate.macro_f1(df).collect()[0][0]


def test_matrix(spark):
    got = evaluate.confusion_matrix(spark.createDataFrame(PAIRS, SCHEMA))
    cells = {(t, p): n for t, p, n in rows(got)}
    assert len(cells) == 9 and sum(cells.values()) == len(PAIRS)
    assert cells["positive", "positive"] == 2 and cells["negative", "positive"] == 1
    assert cells["neutral", "neutral"] == 0


def test_report(spark):
    report, macro = figures(spark, PAIRS)
    assert report["positive"] == pytest.approx((2 / 3, 2 / 3, 2 / 3, 3))
    assert report["negative"] == pytest.approx((3 / 4, 3 / 4, 3 / 4, 4))
    assert "neutral" not in report
    assert report["accuracy"] == (None, None, 5 / 7, 7)
    assert macro == pytest.approx((2 / 3 + 3 / 4) / 2) == pytest.approx(report["macro avg"][2])
    assert report["weighted avg"][2] == pytest.approx((3 * 2 / 3 + 4 * 3 / 4) / 7)


def test_class_absent_on_one_side(spark):
    report, macro = figures(spark, [("positive", "neutral"), ("positive", "positive")])
    assert report["neutral"] == (0.0, 0.0, 0.0, 0)
    assert report["positive"] == pytest.approx((1.0, 0.5, 2 / 3, 2))
    assert macro == pytest.approx(1 / 3)
    report, macro = figures(spark, [("negative", "negative")] * 3)
    assert macro == 1.0 and report["accuracy"][2] == 1.0


def test_labels_outside_the_usual_three_count(spark):
    pairs = [("positive", "positive"), ("angry", "positive"), ("negative", "angry"), ("angry", "neutral")]
    report, _ = figures(spark, pairs)
    assert report["accuracy"] == (None, None, 0.25, 4)
    assert report["angry"] == (0.0, 0.0, 0.0, 2) and report["positive"] == pytest.approx((0.5, 1.0, 2 / 3, 1))


def test_nothing_to_evaluate(spark):
    report, macro = figures(spark, [])
    assert set(report) == {"accuracy", "macro avg", "weighted avg"} and macro == 0.0


def test_nulls_are_dropped_or_filled_first(spark):
    data = [(1, "positive", "positive"), (2, None, "neutral"), (3, "negative", None), (4, "neutral", "positive")]
    df = spark.createDataFrame(data, "id int, " + SCHEMA)
    dropped = hand_labels.evaluate(df, ["id"])
    assert sum(r[2] for r in rows(dropped["matrix"])) == 2
    filled = hand_labels.evaluate(df, ["id"], fill=True)
    assert sum(r[2] for r in rows(filled["matrix"])) == 4
    assert hand_labels.evaluate(df, ["id"], rows=1)["macro_f1"].collect()[0][0] == 1.0


def test_profile_and_counts(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "n int, s string")
    assert rows(frames.column_profile(df)) == [("n", "int", 3, 2, 1), ("s", "string", 3, 1, 2)]
    assert rows(frames.row_counts({"a": df, "b": df.limit(1)})) == [("a", 3), ("b", 1)]
