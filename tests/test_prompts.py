import pytest

from moodspark import fixed_values as fv
from moodspark.operators import prompts
from moodspark.plans import summarise
from moodspark.sources.tables import write_report_input
from tests.conftest import rows

POSTS = "id bigint, account_name string, post_url string, post_caption string, comment string"


@pytest.fixture(scope="module")
def posts(spark):
    data = [(n, "acc", "u51", "  Many @someone here ", f"comment {n}") for n in range(51)]
    data += [(100 + n, "acc", "u50", "", f"c{n}") for n in range(50)]
    data += [(200, "acc", "blank", "", " "), (201, "acc", "blank", "later caption", "")]
    data += [(300, "acc", "nulls", None, None), (400, "acc", None, "no url", "lost")]
    data += [(500, "acc", "two", "Cap\nline", " see http://x.y @me  now "), (501, "acc", "two", "Cap\nline", "next")]
    return spark.createDataFrame(data, POSTS)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_groups(posts, parts):
    got = {r[0]: r[1:] for r in rows(prompts.post_groups(posts.repartition(parts)))}
    assert set(got) == {"u51", "u50", "blank", "nulls", "two"}
    assert got["u51"][1] == 51 and len(got["u51"][2]) == 50
    assert got["u50"][1] == 50 and got["u50"][2] == [f"c{n}" for n in range(50)]
    assert got["blank"] == ("", 2, ["", ""])
    assert got["nulls"] == (None, 0, [])
    assert got["two"] == ("Cap\nline", 2, ["see now", "next"])
    numbers = [int(c.split()[1]) for c in got["u51"][2]]
    assert numbers == sorted(numbers)


def expected_prompt(caption, count, comments):
    listed = "".join(f"{i}. {c}\n" for i, c in enumerate(comments, 1))
    return (
        f"Пост:\n    {caption}\n    \n    Комментарии ({count}):\n    {listed}" + fv.POST_PROMPT_TASK
    )


def test_post_prompts(posts):
    clean = {r[0]: r[3] for r in rows(prompts.post_prompts(prompts.post_groups(posts)))}
    assert clean["two"] == expected_prompt("Cap line", 2, ["see now", "next"])
    assert clean["nulls"] == expected_prompt("", 0, [])
    assert clean["blank"] == expected_prompt("", 2, ["", ""])
    assert "@someone" not in clean["u51"] and "Комментарии (51)" in clean["u51"]
    as_written = {
        r[0]: r[3]
        for r in rows(prompts.post_prompts(prompts.post_groups(posts, redact=False), redact=False))
    }
    assert as_written["two"] == expected_prompt("Cap\nline", 2, ["see http://x.y @me  now", "next"])


@pytest.fixture(scope="module")
def outlets(spark):
    articles = spark.createDataFrame(
        [("a", 1, "T1", "Text one. More. Rest."), ("b", 1, "T2", "Same id"), ("a", 2, "T3", "  "),
         ("a", 3, "T4", "Only nulls"), ("a", 4, "T5", None)],
        "source string, article_id bigint, title string, content string",
    )
    comments = spark.createDataFrame(
        [("a", 1, n, f"c{n}") for n in (7, 3, 9, 1, 5, 8)] + [("a", 1, 2, None), ("a", 2, 1, "x"), ("a", 3, 1, None), ("b", 9, 1, "y")],
        "source string, article_id bigint, id bigint, comment string",
    )
    return articles, comments


def test_article_prompts(outlets):
    articles, comments = outlets
    texts = articles.withColumnRenamed("content", "text")
    kept = prompts.with_comments(texts, comments)
    assert rows(kept.select("source", "article_id")) == [("a", 1), ("a", 2), ("a", 3)]
    made = prompts.article_prompts(prompts.fetch_comments(texts, comments)).select("source", "article_id", "prompt")
    got = {r[:2]: r[2] for r in rows(made)}
    assert got["a", 1] == (
        "\nСТАТЬЯ:\nText one. More. Rest.\n\nКОММЕНТАРИИ:\nc1\nc3\nc5\nc7\nc8" + fv.ARTICLE_PROMPT_TASK
    )
    assert got["b", 1] == "\nСТАТЬЯ:\nSame id\n\nКОММЕНТАРИИ:\nНет комментариев." + fv.ARTICLE_PROMPT_TASK


def shouting():
    def call(prompt):
        if "nulls" in prompt:
            raise RuntimeError("too long")
        return f" {len(prompt)} "

    return call


def test_summarise_articles(outlets):
    articles, comments = outlets
    lead = rows(summarise.summarise_articles(articles, comments))
    assert lead == [("a", 1, "T1", "Text one. More."), ("a", 3, "T4", "Only nulls")]
    made = summarise.summarise_articles(articles, comments, shouting, parallel_calls=3)
    got = {r[:2]: r[3] for r in rows(made)}
    assert got["a", 3] == "[ERROR] too long" and got["a", 1].strip().isdigit()


def test_summarise_posts(posts):
    lead = {r[0]: r[1:] for r in rows(summarise.summarise_posts(posts))}
    assert lead["two"] == ("Cap\nline", 2, "Cap line") and lead["nulls"] == (None, 0, "")
    made = summarise.summarise_posts(posts, lambda: _fail_on_two, parallel_calls=2)
    got = {r[0]: r[3] for r in rows(made)}
    assert got["two"] == fv.POST_ERROR_TEXT and got["u50"] == "fine"


def _fail_on_two(prompt):
    if "see now" in prompt:
        raise ValueError("no")
    return "  fine\n"


def test_report(spark, tmp_path):
    moods = spark.createDataFrame(
        [("1", "positive"), ("2", "negative"), ("3", "no comment")], "article_id string, mood string"
    )
    reactions = spark.createDataFrame([("1", "positive"), ("2", "positive"), ("3", "negative")], "article_id string, dominant_sentiment string")
    quotes = spark.createDataFrame([("1", n, f"quote {n}") for n in range(30)] + [("2", 1, "")], "article_id string, id bigint, clean_comment string")
    posts = spark.createDataFrame([(f"p{n}", f"caption {n}", "neutral") for n in range(3)], "post_url string, post_caption string, average_sentiment string")
    summaries = spark.createDataFrame([(f"p{n}", f" s{n} ") for n in range(9)], "post_url string, summary string")
    none = spark.createDataFrame([], "source string, article_id bigint, summary string")
    lines = prompts.report_lines(moods, reactions, quotes, posts, summaries, none)
    path = tmp_path / "report"
    write_report_input(lines, str(path))
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(path.glob("part-*")))
    assert text.startswith(fv.REPORT_ROLE + "\n\n" + fv.REPORT_ORDER + "\n\nСводка:\n- Количество проанализированных статей: 3\n")
    assert (
        "    - Позитивное: 1 (33.3%)\n    - Нейтральное: 0 (0.0%)\n    - Негативное: 1 (33.3%)\n"
        "    - Без комментариев: 1 (33.3%)\n" in text
    )
    assert "(по реакциям): positive, negative\n" in text
    assert sum(line.startswith('- "') for line in text.splitlines()) == 10
    assert text.count("- s") == 5 and fv.REPORT_ARTICLE_SUMMARIES_EMPTY in text
    assert "Этот пост: caption 0, вызвал такую реакцию: neutral\nЭтот пост: caption 1" in text
    assert text.rstrip().endswith(fv.REPORT_TASK)
    absent = rows(prompts.report_lines(moods, reactions.limit(0), quotes, posts))
    said = "\n".join(r[2] for r in absent)
    assert fv.REPORT_POST_SUMMARIES_ABSENT in said and fv.REPORT_ARTICLE_SUMMARIES_ABSENT in said
    assert fv.REPORT_NO_REACTIONS in said


def test_calls_in_batches(spark):
    """A batch that fails is tried prompt by prompt; every prompt has its own result."""
    df = spark.createDataFrame([(k, f"text {k}" if k != 7 else "fail") for k in range(25)], "k int, prompt string")

    def make():
        def call(texts):
            assert len(texts) <= 4
            if "fail" in texts:
                raise ValueError("no")
            return [t.upper() for t in texts]

        return call

    got = prompts.generate(df, make, batch_size=4, parallel_calls=3, key="k", error=lambda e: f"E {e}")
    assert rows(got.select("k", "summary")) == rows(
        spark.createDataFrame([(k, f"TEXT {k}" if k != 7 else "E no") for k in range(25)], "k int, s string")
    )


def test_counts_of_the_report_are_one_aggregate(spark):
    moods = spark.createDataFrame([(1, "positive"), (2, "neutral"), (3, "positive")], "article_id int, mood string")
    reactions = spark.createDataFrame([(1, "negative"), (2, None)], "article_id int, dominant_sentiment string")
    tally = prompts._tally(moods, reactions).first()
    assert tuple(tally.moods) == (3, 2, 1, 0, 0) and [tuple(r) for r in tally.reacted] == [(-1, "negative")]
    nothing = prompts._tally(moods.limit(0), reactions.limit(0)).first()
    assert tuple(nothing.moods) == (0, 0, 0, 0, 0) and nothing.reacted == []
