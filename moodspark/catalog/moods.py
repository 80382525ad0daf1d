"""Label counts, moods, distributions, and the prompts and reports made of them."""

from pyspark.sql import functions as F

from moodspark import fixed_values as fv
from moodspark.catalog import inputs as i
from moodspark.catalog import query
from moodspark.catalog.inputs import TEST_LEXICON
from moodspark.functions.text import clean_text
from moodspark.operators import frames, mood, prompts
from moodspark.operators.scoring import score_lexicon, score_lexicon_table, score_text
from moodspark.operators.skew import balanced_join
from moodspark.plans import analyse, summarise


@query(i.SQL_COUNTS)
def label_counts(spark, sf):
    return mood.count_labels(i.labelled(spark, sf), "article_id")


@query(i.SQL_COMMENT_MOOD)
def plurality_mood(spark, sf):
    return mood.comment_mood(i.labelled(spark, sf), "article_id")


@query(i.SQL_REACTION_SUMS)
def reaction_sums(spark, sf):
    return mood.sum_reactions(i.reactions(spark, sf), "article_id", i.TEST_REACTIONS)


@query(i.SQL_REACTION_MOOD)
def dominant_reaction(spark, sf):
    return mood.reaction_mood(i.reactions(spark, sf), "article_id", i.TEST_REACTIONS)


_SQL_MAJORITY = """
    SELECT {key}, sentiment AS average_sentiment FROM
        (SELECT {key}, sentiment, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, sentiment) AS rn
         FROM (SELECT {key}, sentiment, count(*) AS n FROM ({rows})
               WHERE {key} IS NOT NULL GROUP BY ALL))
    WHERE rn = 1"""


@query(_SQL_MAJORITY.format(key="article_id", rows=i.SQL_LABELLED))
def majority_label_per_article(spark, sf):
    return mood.majority_label(i.labelled(spark, sf), "article_id")


_SQL_LABELLED_POSTS = f"SELECT *, {i.sql_reaction('split_part(comment, chr(32), 1)')} AS sentiment FROM ({i.SQL_POSTS})"


def _labelled_posts(spark, sf):
    """Posts whose comments carry their event's label; comments without one have none."""
    return i.posts(spark, sf).withColumn(
        "sentiment",
        mood.map_reaction(F.substring_index("comment", " ", 1), i.TEST_REACTIONS),
    )


@query(_SQL_MAJORITY.format(
    key="post_caption", rows=f"SELECT * FROM ({_SQL_LABELLED_POSTS}) WHERE sentiment IS NOT NULL"
))
def majority_label_per_caption(spark, sf):
    return analyse.post_reactions(_labelled_posts(spark, sf), key="post_caption")


@query(i.SQL_ARTICLE_MOODS)
def article_moods(spark, sf):
    return mood.article_moods(
        i.articles(spark, sf).select("article_id", "source"),
        i.labelled(spark, sf),
        i.reactions(spark, sf),
        i.TEST_REACTIONS,
    )


_SQL_MOODS = "(VALUES ('negative'), ('neutral'), ('positive'), ('no comment')) m(mood)"


@query(f"""
    WITH a AS ({i.SQL_ARTICLE_MOODS})
    SELECT m.mood, CAST(count(a.mood) AS BIGINT) AS n_articles,
           CAST(count(a.mood) AS DOUBLE) / CAST((SELECT count(*) FROM a) AS DOUBLE) AS share
    FROM {_SQL_MOODS} LEFT JOIN a ON a.mood = m.mood GROUP BY m.mood""")
def mood_distribution(spark, sf):
    return mood.mood_distribution(article_moods(spark, sf))


@query(f"""
    WITH a AS ({i.SQL_ARTICLE_MOODS}),
         s AS (SELECT source, count(*) AS n FROM a GROUP BY source)
    SELECT s.source, m.mood, CAST(count(a.mood) AS BIGINT) AS n_articles,
           CAST(count(a.mood) AS DOUBLE) / CAST(s.n AS DOUBLE) AS share
    FROM s JOIN {_SQL_MOODS} ON true
    LEFT JOIN a ON a.source = s.source AND a.mood = m.mood
    GROUP BY s.source, s.n, m.mood""")
def mood_distribution_by_source(spark, sf):
    return analyse.mood_by_source(article_moods(spark, sf))


@query(f"""
    WITH a AS (SELECT source, mood FROM ({i.SQL_ARTICLE_MOODS})
               UNION ALL SELECT {i.sql_text(fv.SOURCE_POSTS)} AS source,
                      CASE WHEN positive > greatest(negative, neutral) THEN 'positive'
                           WHEN negative > greatest(positive, neutral) THEN 'negative' ELSE 'neutral' END
               FROM (SELECT post_url, count(*) FILTER (s = 'positive') AS positive, count(*) FILTER (s = 'neutral') AS neutral,
                            count(*) FILTER (s = 'negative') AS negative
                     FROM (SELECT post_url, {i.sql_label(i.sql_clean('comment'))} AS s FROM ({i.SQL_POSTS}))
                     GROUP BY post_url)),
         s AS (SELECT source, count(*) AS n FROM a GROUP BY source)
    SELECT s.source, m.mood, CAST(count(a.mood) AS BIGINT) AS n_articles,
           CAST(count(a.mood) AS DOUBLE) / CAST(s.n AS DOUBLE) AS share
    FROM s JOIN {_SQL_MOODS} ON true
    LEFT JOIN a ON a.source = s.source AND a.mood = m.mood
    GROUP BY s.source, s.n, m.mood""")
def moods_of_all_sources(spark, sf):
    """Clean, label and mood as one run: articles by reactions and comments, posts by comments."""
    frames = analyse.Frames(
        articles=i.articles(spark, sf), comments=i.comments(spark, sf), reactions=i.reactions(spark, sf), posts=i.posts(spark, sf)
    )
    label = lambda df, column: score_lexicon(df, column, i.TEST_LEXICON)
    return analyse.analyse(frames, label, i.TEST_REACTIONS, keep=False)["sources"]


def _sql_words(c):
    return f"unnest(regexp_extract_all(lower({c}), '[{i.WORD_CHARS}]+(?:''[{i.WORD_CHARS}]+)*'))"


@query(f"""
    WITH lexicon AS (SELECT DISTINCT word, CASE WHEN length(word) % 2 = 0 THEN 1 ELSE -1 END * length(word) AS weight
                     FROM (SELECT {_sql_words("text")} AS word FROM documents)),
         said AS (SELECT conv_id, turn, {_sql_words("coalesce(text, '')")} AS word FROM conversations),
         scores AS (SELECT conv_id, turn, sum(weight) AS score FROM said JOIN lexicon USING (word) GROUP BY conv_id, turn)
    SELECT c.conv_id, c.turn,
           CASE sign(coalesce(s.score, 0)) WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS sentiment
    FROM conversations c LEFT JOIN scores s ON s.conv_id = c.conv_id AND s.turn = c.turn""")
def large_lexicon_labels(spark, sf):
    """A lexicon of all words of the documents."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"[{i.WORD_CHARS}]+(?:'[{i.WORD_CHARS}]+)*"), F.lit(0))
    lexicon = i.table(spark, sf, "documents").select(F.explode(words).alias("word")).distinct()
    size = F.length("word")
    lexicon = lexicon.withColumn("weight", F.when(size % 2 == 0, size).otherwise(-size))
    turns = i.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return score_lexicon_table(turns, "text", lexicon, ["conv_id", "turn"]).drop("text")


_SQL_LABELLED_DOCS = f"SELECT doc_id, source, {i.sql_label(i.sql_clean('text'))} AS sentiment FROM documents"


@query(f"""
    SELECT *, CASE WHEN positive > greatest(negative, neutral) THEN 'positive'
                   WHEN negative > greatest(positive, neutral) THEN 'negative'
                   ELSE 'neutral' END AS mood
    FROM (SELECT source,
                 CAST(count(*) FILTER (sentiment = 'negative') AS BIGINT) AS negative,
                 CAST(count(*) FILTER (sentiment = 'neutral') AS BIGINT) AS neutral,
                 CAST(count(*) FILTER (sentiment = 'positive') AS BIGINT) AS positive
          FROM ({_SQL_LABELLED_DOCS}) GROUP BY source)""")
def mood_by_source(spark, sf):
    texts = i.table(spark, sf, "documents")
    docs = texts.select("source", clean_text("text").alias("clean"))
    return mood.comment_mood(score_lexicon(docs, "clean", i.TEST_LEXICON), "source")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def top_reactions(spark, sf):
    return mood.top_labels(i.table(spark, sf, "events"), "event_type")


@query(f"""
    SELECT post_url, arg_min(post_caption, id) AS caption, CAST(count(comment) AS BIGINT) AS comment_count,
           string_agg({i.sql_clean('comment')}, chr(10) ORDER BY id) FILTER (rn <= 50) AS comments
    FROM (SELECT *, row_number() OVER (PARTITION BY post_url
              ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn FROM ({i.SQL_POSTS}))
    GROUP BY post_url""")
def post_comment_groups(spark, sf):
    groups = prompts.post_groups(i.posts(spark, sf))
    return groups.withColumn("comments", F.array_join("comments", "\n"))


@query("""SELECT 'articles' AS frame, CAST(count(*) AS BIGINT) AS n_rows FROM documents
          UNION ALL SELECT 'comments', CAST(count(*) AS BIGINT) FROM conversations WHERE role = 'user'
          UNION ALL SELECT 'reactions', CAST(count(*) AS BIGINT) FROM events""")
def frame_row_counts(spark, sf):
    return frames.row_counts(
        {
            "articles": i.articles(spark, sf),
            "comments": i.comments(spark, sf),
            "reactions": i.reactions(spark, sf),
        }
    )


# --- labelling --------------------------------------------------------------------


@query(f"SELECT doc_id, {i.sql_label(i.sql_clean('text'))} AS sentiment FROM documents")
def lexicon_labels(spark, sf):
    texts = i.table(spark, sf, "documents")
    docs = texts.select("doc_id", clean_text("text").alias("clean"))
    return score_lexicon(docs, "clean", i.TEST_LEXICON).select("doc_id", "sentiment")


def _batch_scorer():
    """A stand-in for a model: loaded once per task, scores a batch, gives class indexes."""
    import regex

    word = regex.compile(r"[\p{L}\p{N}_]+")
    weight = TEST_LEXICON.get

    def score(batch):
        totals = (sum(weight(t, 0) for t in word.findall(text.lower())) for text in batch)
        return [(n > 0) - (n < 0) + 1 for n in totals]

    return score


@query(f"SELECT conv_id, turn, {i.sql_label('text')} AS sentiment FROM conversations")
def plugin_labels(spark, sf):
    turns = i.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return score_text(
        turns, "text", _batch_scorer, fv.LABELS, spread_by=["conv_id", "turn"]
    ).select("conv_id", "turn", "sentiment")


# --- prompts ----------------------------------------------------------------------

_SQL_NUMBERED = f"""
    SELECT post_url, arg_min(post_caption, id) AS caption, count(comment) AS n,
           string_agg(CAST(place AS VARCHAR) || '. ' || {i.sql_clean('comment')}, chr(10) ORDER BY id)
               FILTER (rn <= 50) AS lines
    FROM (SELECT *, row_number() OVER (PARTITION BY post_url, rn <= 50 ORDER BY id) AS place
          FROM (SELECT *, row_number() OVER (PARTITION BY post_url
                    ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn FROM ({i.SQL_POSTS})))
    GROUP BY post_url"""


def _text(value):
    """An SQL literal; line breaks stay as they are."""
    return "'" + value.replace("'", "''") + "'"


@query(f"SELECT post_url, lines FROM ({_SQL_NUMBERED})")
def numbered_comment_lists(spark, sf):
    groups = prompts.post_groups(i.posts(spark, sf))
    return groups.select("post_url", prompts.numbered_list("comments").alias("lines"))


_SQL_POST_PROMPT = f"""
    SELECT post_url, {_text(fv.POST_PROMPT_HEAD)} || {i.sql_clean('caption')}
           || {_text(fv.POST_PROMPT_COUNT)} || CAST(n AS VARCHAR) || {_text(fv.POST_PROMPT_LIST)}
           || lines || chr(10) || {_text(fv.POST_PROMPT_TASK)} AS prompt
    FROM ({_SQL_NUMBERED})"""


@query(_SQL_POST_PROMPT)
def post_prompts(spark, sf):
    groups = prompts.post_groups(i.posts(spark, sf))
    return prompts.post_prompts(groups).select("post_url", "prompt")


_SQL_ARTICLE_PROMPT = f"""
    WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
               FROM conversations WHERE role = 'user' AND text IS NOT NULL),
         l AS (SELECT conv_id, string_agg({i.sql_clean('text')}, chr(10) ORDER BY turn) AS comments
               FROM c WHERE rn <= 5 GROUP BY conv_id)
    SELECT d.doc_id AS article_id,
           {_text(fv.ARTICLE_PROMPT_HEAD)} || {i.sql_clean('d.text')} || {_text(fv.ARTICLE_PROMPT_LIST)}
           || coalesce(l.comments, {_text(fv.ARTICLE_NO_COMMENTS)}) || {_text(fv.ARTICLE_PROMPT_TASK)} AS prompt
    FROM documents d LEFT JOIN l ON l.conv_id = d.doc_id"""


@query(_SQL_ARTICLE_PROMPT)
def article_prompts(spark, sf):
    articles = frames.normalise_article(i.articles(spark, sf), ["article_id", "text"])
    listed = prompts.fetch_comments(articles, i.comments(spark, sf), ["article_id"])
    return prompts.article_prompts(listed).select("article_id", "prompt")


_SQL_POST_REACTIONS = f"""
    SELECT p.post_url, p.post_caption, m.average_sentiment
    FROM (SELECT post_url, arg_min(post_caption, id) AS post_caption FROM ({i.SQL_POSTS}) GROUP BY post_url) p
    JOIN ({_SQL_MAJORITY.format(
        key="post_url", rows=f"SELECT * FROM ({_SQL_LABELLED_POSTS}) WHERE sentiment IS NOT NULL"
    )}) m ON m.post_url = p.post_url"""


@query(f"""SELECT post_url, {_text(fv.POST_SENTENCE_HEAD)} || {i.sql_clean('post_caption')}
                  || {_text(fv.POST_SENTENCE_MIDDLE)} || average_sentiment AS line
           FROM ({_SQL_POST_REACTIONS})""")
def post_sentences(spark, sf):
    reacted = analyse.post_reactions(_labelled_posts(spark, sf))
    return prompts.post_sentences(reacted).select("post_url", "line")


# --- summaries --------------------------------------------------------------------


def _sql_lead(c):
    clean = i.sql_clean(c)
    lead = rf"regexp_extract({clean}, '\A((?:[^.!?]*[.!?]+ ?){{1,2}})', 1)"
    return f"trim(CASE WHEN {lead} = '' THEN {clean} ELSE {lead} END)"


_SQL_COMMENTED = f"""
    SELECT doc_id, source, text FROM documents d
    WHERE NOT {i.sql_blank('text')}
      AND EXISTS (SELECT 1 FROM conversations c WHERE c.role = 'user' AND c.conv_id = d.doc_id)"""


def _summary_inputs(spark, sf):
    docs = i.table(spark, sf, "documents").select(
        F.col("doc_id").alias("article_id"), "source", F.col("lang").alias("title"),
        F.col("text").alias("content"),
    )
    sources = docs.select("article_id", "source")
    said = balanced_join(
        i.comments(spark, sf), sources, ["article_id"], "inner", spread_by=["id"]
    )
    return docs, said


@query(f"SELECT doc_id AS article_id, source, {_sql_lead('text')} AS summary FROM ({_SQL_COMMENTED})")
def article_summaries(spark, sf):
    docs, said = _summary_inputs(spark, sf)
    return summarise.summarise_articles(docs, said).drop("title")


def _prompt_length():
    """A stand-in for a model call; it fails on some prompts."""

    def call(prompt):
        if len(prompt) % 7 == 0:
            raise ValueError("no answer")
        return f"{len(prompt)} characters"

    return call


@query(f"""SELECT a.article_id, d.source,
                  CASE WHEN length(prompt) % 7 = 0 THEN '[ERROR] no answer'
                       ELSE CAST(length(prompt) AS VARCHAR) || ' characters' END AS summary
           FROM ({_SQL_ARTICLE_PROMPT}) a JOIN ({_SQL_COMMENTED}) d ON d.doc_id = a.article_id""")
def generated_article_summaries(spark, sf):
    docs, said = _summary_inputs(spark, sf)
    return summarise.summarise_articles(docs, said, _prompt_length).drop("title")


@query(f"""SELECT post_url, caption, CAST(n AS BIGINT) AS comment_count, {_sql_lead('caption')} AS summary
           FROM ({_SQL_NUMBERED})""")
def post_summaries(spark, sf):
    return summarise.summarise_posts(i.posts(spark, sf))


@query(f"""SELECT post_url, CASE WHEN length(prompt) % 7 = 0 THEN {_text(fv.POST_ERROR_TEXT)}
                       ELSE CAST(length(prompt) AS VARCHAR) || ' characters' END AS summary
           FROM ({_SQL_POST_PROMPT})""")
def generated_post_summaries(spark, sf):
    made = summarise.summarise_posts(i.posts(spark, sf), _prompt_length)
    return made.select("post_url", "summary")


_SQL_BLOCK = f"""
    SELECT coalesce(string_agg('- ' || {i.sql_strip('summary')}, chr(10) || chr(10) ORDER BY place, doc_id),
                    {_text(fv.REPORT_ARTICLE_SUMMARIES_EMPTY)}) AS block
    FROM (SELECT doc_id, {_sql_lead('text')} AS summary,
                 md5('42:' || source || ':' || CAST(doc_id AS VARCHAR)) AS place
          FROM ({_SQL_COMMENTED}) ORDER BY place, source, doc_id LIMIT 5)"""


@query(_SQL_BLOCK)
def summary_block(spark, sf):
    docs, said = _summary_inputs(spark, sf)
    summaries = summarise.summarise_articles(docs, said)
    return prompts.summary_block(
        summaries, ["source", "article_id"],
        fv.REPORT_ARTICLE_SUMMARIES_EMPTY, fv.REPORT_ARTICLE_SUMMARIES_ABSENT,
    )


def _report(spark, sf):
    docs, said = _summary_inputs(spark, sf)
    quotes = i.comments(spark, sf).select(
        "article_id", "id", clean_text("comment").alias("clean_comment")
    )
    return prompts.report_lines(
        article_moods(spark, sf),
        dominant_reaction(spark, sf),
        quotes,
        analyse.post_reactions(_labelled_posts(spark, sf)),
        None,
        summarise.summarise_articles(docs, said),
    )


_MOOD_ROWS = ", ".join(
    f"({n}, '{m}', {_text(fv.REPORT_MOOD_NAMES[m])})"
    for n, m in enumerate(("positive", "neutral", "negative", "no comment"), 1)
)


def _sql_fixed(section, lines):
    rows = ", ".join(f"({section}, '{n:04d}', {_text(t)})" for n, t in enumerate(lines))
    return f"SELECT * FROM (VALUES {rows}) f(section, position, line)"


@query(f"""
    WITH a AS ({i.SQL_ARTICLE_MOODS}),
         r AS ({i.SQL_REACTION_MOOD}),
         per_mood AS (
             SELECT m.place, m.name, count(a.mood) AS n,
                    CAST(floor(CAST(count(a.mood) AS DOUBLE) / (SELECT count(*) FROM a) * 1000 + 0.5) AS BIGINT) AS tenths
             FROM (VALUES {_MOOD_ROWS}) m(place, mood, name) LEFT JOIN a ON a.mood = m.mood GROUP BY ALL)
    {_sql_fixed(0, [fv.REPORT_ROLE, "", fv.REPORT_ORDER, "", fv.REPORT_SUMMARY_HEAD])}
    UNION ALL SELECT 1, '0000', {_text(fv.REPORT_COUNT)} || CAST(count(*) AS VARCHAR) || chr(10) || {_text(fv.REPORT_MOODS)} FROM a
    UNION ALL SELECT 2, lpad(CAST(place AS VARCHAR), 4, '0'),
              name || CAST(n AS VARCHAR) || ' (' || CAST(tenths // 10 AS VARCHAR) || '.' || CAST(tenths % 10 AS VARCHAR) || '%)'
              FROM per_mood
    UNION ALL SELECT 3, '0000', {_text(fv.REPORT_TOP_REACTIONS)} || coalesce(string_agg(label, ', ' ORDER BY n DESC, label), {_text(fv.REPORT_NO_REACTIONS)})
              FROM (SELECT dominant_sentiment AS label, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5)
    UNION ALL {_sql_fixed(4, ["", fv.REPORT_QUOTES_HEAD])}
    UNION ALL SELECT 5, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), '- "' || clean || '"'
              FROM (SELECT conv_id, turn, {i.sql_clean('text')} AS clean FROM conversations WHERE role = 'user'
                    ORDER BY md5('42:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), conv_id, turn LIMIT 10)
    UNION ALL SELECT 6, '0000', chr(10) || {_text(fv.REPORT_POST_SUMMARIES)} || chr(10) || {_text(fv.REPORT_POST_SUMMARIES_ABSENT)}
    UNION ALL SELECT 7, '0000', chr(10) || {_text(fv.REPORT_ARTICLE_SUMMARIES)} || chr(10) || block FROM ({_SQL_BLOCK})
    UNION ALL {_sql_fixed(8, [""])}
    UNION ALL SELECT 9, post_url, {_text(fv.POST_SENTENCE_HEAD)} || {i.sql_clean('post_caption')}
              || {_text(fv.POST_SENTENCE_MIDDLE)} || average_sentiment FROM ({_SQL_POST_REACTIONS})
    UNION ALL {_sql_fixed(10, ["", fv.REPORT_TASK_HEAD, fv.REPORT_TASK])}""")
def report_input(spark, sf):
    return _report(spark, sf)
