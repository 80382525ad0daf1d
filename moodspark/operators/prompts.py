"""Prompt tables for posts, articles and the report, and running a caller's text function."""

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodspark import fixed_values as fv
from moodspark.fixed_values import ARTICLE_ERROR_HEAD
from moodspark.functions.text import bulleted_block, clean_text, numbered_list, strip
from moodspark.operators.sampling import (
    first_captions,
    first_comments,
    sample_per_group,
    sample_rows,
    shuffled_head,
)

TextFunction = Callable[[str], str]


def _shown(c: Column, redact: bool) -> Column:
    """Text as it may be shown: cleaned, which also removes mentions, or only trimmed."""
    return clean_text(c) if redact else F.coalesce(strip(c), F.lit(""))


def _in_order(order: str, text: Column, name: str) -> Column:
    """Texts of a group in order.  Only ever applied to groups already cut to k rows."""
    picked = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.transform(picked, lambda s: s["t"]).alias(name)


def post_groups(
    comments: DataFrame,
    k: int = fv.POST_PROMPT_COMMENTS,
    redact: bool = True,
    seed: int = fv.SAMPLE_SEED,
) -> DataFrame:
    """post_url, caption, comment_count, comments.

    The count is that of all non-null comments; the list holds at most k of them.  Counting
    and listing are separate aggregates, so no task ever sees all comments of a post.
    """
    posts = comments.where(F.col("post_url").isNotNull())
    totals = first_captions(posts, {"comment_count": F.count("comment")}).withColumnRenamed("post_caption", "caption")
    shown = posts.where(F.col("comment").isNotNull()).select("post_url", "id", "comment")
    lists = (
        sample_per_group(shown, ["post_url"], ["id"], k, seed)
        .groupBy("post_url")
        .agg(_in_order("id", _shown(F.col("comment"), redact), "comments"))
    )
    none = F.array().cast("array<string>")
    return totals.join(lists, "post_url", "left").withColumn(
        "comments", F.coalesce("comments", none)
    )


def post_prompts(groups: DataFrame, redact: bool = True) -> DataFrame:
    """post_url, caption, comment_count, prompt."""
    listed = F.when(
        F.size("comments") > 0, F.concat(numbered_list("comments"), F.lit("\n"))
    ).otherwise(F.lit(""))
    prompt = F.concat(
        F.lit(fv.POST_PROMPT_HEAD),
        _shown(F.col("caption"), redact),
        F.lit(fv.POST_PROMPT_COUNT),
        F.col("comment_count").cast("string"),
        F.lit(fv.POST_PROMPT_LIST),
        listed,
        F.lit(fv.POST_PROMPT_TASK),
    )
    return groups.select("post_url", "caption", "comment_count", prompt.alias("prompt"))


def with_comments(
    articles: DataFrame, comments: DataFrame, keys: Sequence[str] = ("source", "article_id")
) -> DataFrame:
    """Articles that have at least one comment, of the same source."""
    # one row per article before the join, however many comments it has
    commented = comments.select(*keys).distinct()
    return articles.join(commented, list(keys), "left_semi")


def fetch_comments(
    articles: DataFrame,
    comments: DataFrame,
    keys: Sequence[str] = ("source", "article_id"),
    order: str = "id",
    k: int = fv.ARTICLE_PROMPT_COMMENTS,
    redact: bool = True,
) -> DataFrame:
    """Every article with its first k non-null comments, an empty list if it has none."""
    keys = list(keys)
    known = comments.where(F.col("comment").isNotNull()).select(*keys, order, "comment")
    lists = (
        first_comments(known, keys, [order], k)
        .groupBy(*keys)
        .agg(
            _in_order(
                order, clean_text("comment") if redact else F.col("comment"), "comments"
            )
        )
    )
    none = F.array().cast("array<string>")
    return articles.join(lists, keys, "left").withColumn("comments", F.coalesce("comments", none))


def article_prompts(articles: DataFrame, text: str = "text", redact: bool = True) -> DataFrame:
    """Adds ``prompt``: the text and its first comments, or a remark that there are none.

    The text is cleaned, which removes mentions, unless ``redact`` is off.
    """
    shown = F.when(F.size("comments") > 0, F.array_join("comments", "\n")).otherwise(
        F.lit(fv.ARTICLE_NO_COMMENTS)
    )
    return articles.withColumn(
        "prompt",
        F.concat(
            F.lit(fv.ARTICLE_PROMPT_HEAD),
            _shown(F.col(text), redact),
            F.lit(fv.ARTICLE_PROMPT_LIST),
            shown,
            F.lit(fv.ARTICLE_PROMPT_TASK),
        ),
    )


def post_sentences(
    majority: DataFrame, caption: str = "post_caption", redact: bool = True
) -> DataFrame:
    """One line per post: its caption, cleaned unless ``redact`` is off, and the reaction to it.

    A line is a row, not a part of one long text, since there is no bound on the number of
    posts.
    """
    return majority.withColumn(
        "line",
        F.concat(
            F.lit(fv.POST_SENTENCE_HEAD),
            _shown(F.col(caption), redact),
            F.lit(fv.POST_SENTENCE_MIDDLE),
            F.col("average_sentiment"),
        ),
    )


def summary_block(
    summaries: DataFrame | None,
    keys: Sequence[str],
    empty_text: str,
    absent_text: str,
    k: int = fv.REPORT_SUMMARIES,
    seed: int = fv.SAMPLE_SEED,
) -> DataFrame | Column:
    """A few summaries as a bulleted text, in one row ``block``.

    Without a table of summaries it is the remark that they are absent, as a column.
    """
    if summaries is None:
        return F.lit(absent_text)
    known = summaries.where(F.col("summary").isNotNull())
    head = shuffled_head(known, keys, k, seed)
    return head.agg(_in_order("place", F.col("summary"), "texts")).select(
        bulleted_block("texts", empty_text).alias("block")
    )


def report_lines(
    article_moods: DataFrame,
    reactions: DataFrame,
    quotes: DataFrame,
    post_reactions: DataFrame,
    post_summaries: DataFrame | None = None,
    article_summaries: DataFrame | None = None,
    quote_keys: Sequence[str] = ("article_id", "id"),
    post_key: str = "post_url",
    seed: int = fv.SAMPLE_SEED,
) -> DataFrame:
    """The report input as lines (section, position, line); sort by the first two to read it.

    All parts but the sentences per post are of fixed size.  Those have a row per post, so
    they stay a distributed table: see write_report_input.

    ``reactions`` has a ``dominant_sentiment`` per article, ``quotes`` a ``clean_comment``.  All
    counts come from one aggregate, whose row is expanded into the lines of fixed size.
    """
    tally = _tally(article_moods, reactions)
    fixed = [(0, fv.REPORT_ROLE, "", fv.REPORT_ORDER, "", fv.REPORT_SUMMARY_HEAD), (4, "", fv.REPORT_QUOTES_HEAD)]
    fixed += [(8, ""), (10, "", fv.REPORT_TASK_HEAD, fv.REPORT_TASK)]
    lines = [
        _line(section, F.lit(f"{i:04d}"), F.lit(text)) for section, *texts in fixed for i, text in enumerate(texts)
    ]
    total = F.col("moods").getField("n")
    lines.append(
        _line(1, F.lit("0000"), F.concat(F.lit(fv.REPORT_COUNT), total.cast("string"), F.lit("\n" + fv.REPORT_MOODS)))
    )
    for place, mood in enumerate(REPORT_MOOD_ORDER, 1):
        lines.append(_line(2, F.lit(f"{place:04d}"), _mood_line(mood, F.col("moods").getField(f"m{place}"), total)))
    top = F.transform(F.slice(F.array_sort("reacted"), 1, fv.REPORT_TOP_LABELS), lambda r: r["label"])
    top_text = F.when(F.size(top) > 0, F.array_join(top, ", ")).otherwise(F.lit(fv.REPORT_NO_REACTIONS))
    lines.append(_line(3, F.lit("0000"), F.concat(F.lit(fv.REPORT_TOP_REACTIONS), top_text)))
    parts = []
    for section, table, keys, head, empty_text, absent_text in (
        (6, post_summaries, ["post_url"], fv.REPORT_POST_SUMMARIES, fv.REPORT_POST_SUMMARIES_EMPTY, fv.REPORT_POST_SUMMARIES_ABSENT),
        (7, article_summaries, ["source", "article_id"], fv.REPORT_ARTICLE_SUMMARIES, fv.REPORT_ARTICLE_SUMMARIES_EMPTY, fv.REPORT_ARTICLE_SUMMARIES_ABSENT),
    ):
        text = summary_block(table, keys, empty_text, absent_text, seed=seed)
        head = F.lit("\n" + head + "\n")
        if table is None:
            lines.append(_line(section, F.lit("0000"), F.concat(head, text)))
        else:
            parts.append(text.select(_line(section, F.lit("0000"), F.concat(head, "block")).alias("l")).select("l.*"))
    said = quotes.where(F.col("clean_comment").isNotNull())
    picked = sample_rows(said, quote_keys, fv.REPORT_QUOTES, seed)
    quoted = F.concat(F.lit('- "'), F.col("clean_comment"), F.lit('"'))
    parts.append(picked.select(_line(5, F.concat_ws(":", *quote_keys), quoted).alias("l")).select("l.*"))
    sentences = post_sentences(post_reactions)
    parts.append(sentences.select(_line(9, F.col(post_key), F.col("line")).alias("l")).select("l.*"))
    out = tally.select(F.inline(F.array(*lines)))
    for part in parts:
        out = out.unionByName(part)
    return out


#: Moods in the report's order.
REPORT_MOOD_ORDER = ("positive", "neutral", "negative", fv.NO_COMMENT)


def _line(section: int, position: Column, line: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"), position.cast("string").alias("position"), line.alias("line")
    )


def _mood_line(mood: str, n: Column, total: Column) -> Column:
    # tenths of a percent in whole numbers: the text does not depend on float formatting
    share = F.coalesce(F.try_divide(n.cast("double"), total.cast("double")), F.lit(0.0))
    tenths = F.floor(share * 1000 + 0.5)
    whole, tenth = F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string")
    return F.concat(
        F.lit(fv.REPORT_MOOD_NAMES[mood]), n.cast("string"), F.lit(" ("), whole, F.lit("."), tenth, F.lit("%)")
    )


def _tally(article_moods: DataFrame, reactions: DataFrame) -> DataFrame:
    """One row: ``moods`` (n articles, m1 to m4 of each mood) and ``reacted`` (-n, label) of reactions.

    Articles and reactions are tagged and counted by one grouped aggregate, whose few rows then
    make one.
    """
    tagged = article_moods.select(F.lit(True).alias("article"), F.col("mood").alias("label")).unionByName(
        reactions.select(F.lit(False).alias("article"), F.col("dominant_sentiment").alias("label"))
    )
    counts = tagged.groupBy("article", "label").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), zero)
    return counts.agg(
        F.struct(
            of(F.col("article")).alias("n"),
            *[of(F.col("article") & (F.col("label") == m)).alias(f"m{k}") for k, m in enumerate(REPORT_MOOD_ORDER, 1)],
        ).alias("moods"),
        F.collect_list(F.when(~F.col("article") & F.col("label").isNotNull(), F.struct((-F.col("n")).alias("n"), "label"))).alias("reacted"),
    )


def generate(
    prompts: DataFrame,
    make: Callable[[], Callable],
    prompt: str = "prompt",
    output: str = "summary",
    error: Callable[[str], str] = lambda reason: ARTICLE_ERROR_HEAD + reason,
    parallel_calls: int | None = None,
    key: str | None = None,
    batch_size: int | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Run a caller's text function on every prompt.

    ``make()`` runs once per task and returns the function.  With ``batch_size`` that takes a list
    of so many prompts at most and returns as many texts; else one prompt.  A failing call gives an
    error text in its row and the job goes on; a batch that fails is tried again prompt by prompt,
    so the error is that of its own row.

    ``parallel_calls`` deals the rows by ``key`` over that many partitions.  Partitions may be
    many and small, as how many run at a time is a matter of the tasks' resources: ``profile``
    says what each task needs (stage-level scheduling).  Written with save_stage, each partition's
    results are kept when its task ends, and a lost task repeats its own calls only.
    """
    if parallel_calls:
        prompts = prompts.repartition(parallel_calls, key or prompt)
    schema = T.StructType([*prompts.schema.fields, T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()

        def one(text: str) -> str:
            try:
                return call([text])[0] if batch_size else call(text)
            except Exception as e:  # any failure of the caller's function is that row's result
                return error(str(e))

        def several(texts: list[str]) -> list[str]:
            try:
                made = list(call(texts))
                if len(made) == len(texts):
                    return made
            except Exception:  # which prompt it was shows when they are tried alone
                pass
            return [one(t) for t in texts]

        for batch in batches:
            texts = batch.column(prompt).to_pylist()
            if batch_size:
                parts = [several(texts[k : k + batch_size]) for k in range(0, len(texts), batch_size)]
                made = [t for part in parts for t in part]
            else:
                made = [one(t) for t in texts]
            yield batch.append_column(output, pa.array(made, pa.string()))

    return prompts.mapInArrow(run, schema, profile=profile)
