"""Whole runs: tables on disk -> moods, report, predictions."""

from pyspark.sql import functions as F

from moodspark import schemas
from moodspark.operators.scoring import score_lexicon
from moodspark.plans import analyse, hand_labels
from moodspark.sources import tables
from tests.conftest import rows


def save(spark, root, name, data, schema):
    tables.overwrite(spark.createDataFrame(data, schema), str(root / name))


def outlets(spark, root, posts=True):
    save(spark, root, "gazeta/articles", [(1, "g/1", "t", "c"), (2, "g/2", "t", "c"), (3, "g/3", "t", "c")], schemas.ARTICLES)
    save(spark, root, "gazeta/comments", [(1, 1, "good", 1, 0), (2, 1, "great", 0, 0), (3, 2, "bad <b>good</b> bad", 0, 0)], schemas.COMMENTS_VOTED)
    save(spark, root, "podrobno/articles", [(1, "p/1", "t", "c"), (2, "p/2", "t", "c")], schemas.ARTICLES)
    save(spark, root, "podrobno/comments", [(1, 1, "bad"), (2, 2, "bad")], schemas.COMMENTS_PLAIN)
    save(spark, root, "podrobno/reactions", [(1, 1, "Радость", 3), (2, 1, "Грусть", 1), (3, 2, "Шок", 9)], schemas.REACTIONS)
    if posts:
        save(
            spark, root, "instagram/comments",
            [(1, "a", "u1", "New tax @who", "good @me"), (2, "a", "u1", "New tax @who", "bad"), (3, "a", "u1", "New tax @who", "sad"),
             (4, "a", "u2", "Weather", "good"), (5, "a", "u3", None, "good"), (6, "a", None, "law", "good")],
            schemas.POST_COMMENTS,
        )


def test_analyse(spark, tmp_path):
    outlets(spark, tmp_path)
    frames = analyse.load_frames(spark, str(tmp_path), key_type="bigint")
    out = analyse.analyse(frames)
    moods = dict(rows(out["articles"].select("article_id", "mood")))
    assert moods == {
        "1gazeta": "positive", "2gazeta": "negative", "3gazeta": "no comment",
        "1podrobno": "positive", "2podrobno": "negative",
    }
    reacted = out["posts"].select("post_url", "average_sentiment", "post_caption")
    assert rows(reacted) == [("u1", "negative", "New tax @who"), ("u3", "positive", None)]
    shares = rows(analyse.mood_by_source(out["articles"]), "source", "mood")
    assert len(shares) == 8 and sum(r[2] for r in shares) == 5
    report = "\n".join(r.line for r in out["report"].orderBy("section", "position").collect())
    assert "Количество проанализированных статей: 5" in report
    assert "@" not in report and "New tax, вызвал такую реакцию: negative" in report
    posts = rows(analyse.post_moods(analyse.label_posts(frames.posts)))
    assert posts == [("u1", "instagram", "negative"), ("u3", "instagram", "positive")]
    by_caption = rows(analyse.post_reactions(analyse.label_posts(frames.posts), key="post_caption"))
    assert by_caption == [("New tax @who", "negative"), ("law", "positive")]
    lazy = analyse.analyse(frames, keep=False)
    assert rows(lazy["articles"]) == rows(out["articles"])
    assert rows(lazy["report"]) == rows(out["report"])


def test_write_and_read_back(spark, tmp_path):
    outlets(spark, tmp_path)
    results = analyse.analyse(analyse.load_frames(spark, str(tmp_path), key_type="bigint"))
    for _ in range(2):  # the second run replaces the first
        analyse.write_results(results, str(tmp_path / "out"))
    assert tables.read_table(spark, str(tmp_path / "out/articles")).count() == 5
    assert any((tmp_path / "out/report").glob("part-*.txt"))
    assert analyse.stored_summaries(spark, str(tmp_path / "out")) == (None, None)
    save(spark, tmp_path, "out/post_summaries", [("u1", "New tax", 3, "short")], schemas.POST_SUMMARIES)
    posts, articles = analyse.stored_summaries(spark, str(tmp_path / "out"))
    assert articles is None and rows(posts) == [("u1", "New tax", 3, "short")]


def test_absent_posts(spark, tmp_path):
    outlets(spark, tmp_path, posts=False)
    out = analyse.analyse(analyse.load_frames(spark, str(tmp_path), key_type="bigint"))
    assert out["articles"].count() == 5 and out["posts"].count() == 0


def test_hand_labels_through_csv(spark, tmp_path):
    outlets(spark, tmp_path)
    posts = tables.read_table(spark, str(tmp_path / "instagram/comments"), schemas.POST_COMMENTS)
    predicted = hand_labels.predictions(posts)
    assert rows(predicted)[0] == ("insta_1", "instagram", "good @me", "good", "positive")
    assert {r[0] for r in rows(predicted)} == {"insta_1", "insta_2", "insta_3", "insta_5", "insta_6"}
    by_hand = predicted.withColumn("true_sentiment", F.lit("positive"))
    tables.write_csv(by_hand, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"), schemas.EVALUATION)
    figures = hand_labels.evaluate(back, ["article_id"])
    assert {r[0]: r[4] for r in rows(figures["report"])}["accuracy"] == 5
    assert figures["macro_f1"].collect()[0][0] > 0


def test_own_label_function(spark, tmp_path):
    outlets(spark, tmp_path)
    frames = analyse.load_frames(spark, str(tmp_path), key_type="bigint")
    out = analyse.analyse(frames, lambda df, c: score_lexicon(df, c, {"bad": 1, "good": -1}))
    assert dict(rows(out["articles"].select("article_id", "mood")))["2gazeta"] == "positive"
