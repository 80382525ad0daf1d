"""Scalar functions and page extraction."""

from pyspark.sql import functions as F

from moodspark.catalog import inputs as i
from moodspark.catalog import query
from moodspark.fixed_values import LABELS
from moodspark.functions.text import SPACE_CHARS, clean_text, digits_or_zero, first_sentences, label_at, strip
from moodspark.sources import pages as p

SQL_LEAD = rf"""
    SELECT doc_id, trim(CASE WHEN lead = '' THEN clean ELSE lead END) AS lead FROM
        (SELECT doc_id, clean, regexp_extract(clean, '\A((?:[^.!?]*[.!?]+ ?){{1,2}})', 1) AS lead
         FROM (SELECT doc_id, {i.sql_clean('text')} AS clean FROM documents))"""


@query(f"SELECT doc_id, {i.sql_clean('text')} AS clean FROM documents")
def cleaned_documents(spark, sf):
    return i.table(spark, sf, "documents").select("doc_id", clean_text("text").alias("clean"))


@query(f"SELECT page_id, {i.sql_clean('html')} AS clean FROM pages")
def cleaned_pages(spark, sf):
    return i.table(spark, sf, "pages").select("page_id", clean_text("html").alias("clean"))


@query(f"SELECT doc_id, {i.sql_strip('text')} AS text FROM documents")
def stripped_documents(spark, sf):
    return i.table(spark, sf, "documents").select("doc_id", strip("text").alias("text"))


@query("""SELECT event_id, CASE WHEN regexp_full_match(k, '[0-9]+') THEN CAST(k AS BIGINT) ELSE 0 END AS k,
                 CAST(0 AS BIGINT) AS n
          FROM (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)""")
def digits_of_events(spark, sf):
    return i.table(spark, sf, "events").select(
        "event_id",
        digits_or_zero(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"),
        digits_or_zero("event_type").alias("n"),
    )


@query("""SELECT doc_id, CASE quality WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' END AS quality_label,
                 CASE quality + toxic WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' END AS sum_label
          FROM labels""")
def index_labels(spark, sf):
    return i.table(spark, sf, "labels").select(
        "doc_id",
        label_at("quality", LABELS).alias("quality_label"),
        label_at(F.col("quality") + F.col("toxic"), LABELS).alias("sum_label"),
    )


@query(SQL_LEAD)
def lead_sentences(spark, sf):
    return i.table(spark, sf, "documents").select("doc_id", first_sentences("text").alias("lead"))


# --- pages ------------------------------------------------------------------------

_SQL_VISIBLE = (
    "regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g')"
)


def _sql_resolved(href):
    return f"""
        CASE WHEN regexp_matches({href}, '\\A[A-Za-z][A-Za-z0-9+.-]*:') THEN {href}
             WHEN {href} LIKE '//%' THEN regexp_extract(url, '\\A([A-Za-z][A-Za-z0-9+.-]*:)', 1) || {href}
             WHEN {href} LIKE '#%' THEN regexp_extract(url, '\\A([^#]*)', 1) || {href}
             WHEN {href} LIKE '?%' THEN regexp_extract(url, '\\A([^?#]*)', 1) || {href}
             WHEN {href} LIKE '/%' THEN regexp_extract(url, '\\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {href}
             ELSE CASE WHEN regexp_matches(url, '://[^/?#]*/') THEN regexp_extract(url, '\\A([^?#]*/)', 1)
                       ELSE regexp_extract(url, '\\A([^?#]*)', 1) || '/' END || {href} END"""


def _sql_reference(text):
    for reference, char in p.NAMED_REFERENCES.items():
        char = char.replace("'", "''")
        text = f"replace({text}, '&{reference};', '{char}')"
    return f"replace({text}, '&amp;', '&')"


def _sql_links(where):
    return f"""
    SELECT DISTINCT {_sql_resolved(_sql_reference("href"))} AS link
    FROM (SELECT url, unnest(regexp_extract_all({_SQL_VISIBLE},
              '(?i)<a\\s(?:[^>]*\\s)?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages)
    WHERE href <> '' AND {where}"""


@query(_sql_links("true"))
def page_links(spark, sf):
    return p.extract_links(i.table(spark, sf, "pages"))


@query(_sql_links("regexp_matches(href, '^/[a-m]')"))
def page_links_by_pattern(spark, sf):
    return p.extract_links(i.table(spark, sf, "pages"), "^/[a-m]")


@query(f"""SELECT doc_id, {_sql_resolved("source || '/' || lang")} AS relative,
                  {_sql_resolved("'?q=' || lang")} AS query
           FROM (SELECT doc_id, source, lang, url FROM documents JOIN pages ON page_id = doc_id)""")
def resolved_urls(spark, sf):
    docs = i.table(spark, sf, "documents").select(
        F.col("doc_id"), F.col("doc_id").alias("page_id"), "source", "lang"
    )
    both = docs.join(i.table(spark, sf, "pages").select("page_id", "url"), "page_id")
    return both.select(
        "doc_id",
        p.resolve_url(F.col("url"), F.concat_ws("/", "source", "lang")).alias("relative"),
        p.resolve_url(F.col("url"), F.concat(F.lit("?q="), "lang")).alias("query"),
    )


def _sql_inner(fragment):
    text = f"regexp_replace({fragment}, '[{i.SPACE_CHARS}]+', ' ', 'g')"
    text = f"regexp_replace({text}, '(?i)<br\\s*/?>|</(?:p|div|li|h[1-6])\\s*>', chr(10), 'g')"
    text = _sql_reference(f"regexp_replace({text}, '<[^>]*>', '', 'g')")
    return i.sql_strip(f"regexp_replace({text}, ' *\\n[ \\n]*', chr(10), 'g')")


# A page cut in front of every tag; which parts lie in an element is told by running sums of
# tags that open (1) and close (-1), not by patterns for elements.
_SQL_PARTS = f"""
    cut AS (SELECT page_id, url, unnest(string_split({_SQL_VISIBLE}, '<')) AS part,
                   generate_subscripts(string_split({_SQL_VISIBLE}, '<'), 1) AS n FROM pages),
    parts AS (SELECT page_id, url, n, '<' || part AS part, substr(part, strpos(part, '>') + 1) AS behind,
                     lower(regexp_extract(part, '^/?([A-Za-z][^ />]*)', 1)) AS tag,
                     CASE WHEN part LIKE '/%' THEN -1 ELSE 1 END AS way
              FROM cut WHERE n > 1),
    tags AS (SELECT *, CASE WHEN tag IN ('p', 'div', 'li', 'ul', 'h1', 'nav', 'article', 'footer') THEN way ELSE 0 END AS block
             FROM parts)"""


def _sql_running(value, within):
    return f"CAST(sum({value}) OVER (PARTITION BY {within} ORDER BY n) AS BIGINT)"


def _sql_opens(tag):
    return f"CASE WHEN tag = '{tag}' AND way = 1 THEN 1 ELSE 0 END"


_SQL_FRAGMENT = "string_agg(CASE WHEN first THEN behind ELSE part END, '' ORDER BY n)"

_PAGE_RULE = p.ArticleRule(title=p.Element("h1"), paragraph=p.Element("p"))


@query(f"""
    WITH {_SQL_PARTS},
    heads AS (SELECT page_id, n, part, behind, n = min(n) FILTER (opened = 1) OVER (PARTITION BY page_id) AS first,
                     {_sql_running("CASE WHEN tag = 'h1' THEN way ELSE 0 END", "page_id, opened")} AS depth, opened
              FROM (SELECT *, {_sql_running(_sql_opens('h1'), 'page_id')} AS opened FROM tags)),
    titles AS (SELECT page_id, {_sql_inner(_SQL_FRAGMENT)} AS title FROM heads
               WHERE opened = 1 AND depth > 0 GROUP BY page_id),
    lines AS (SELECT *, row_number() OVER (PARTITION BY page_id, opened ORDER BY n) = 1 AS first,
                     {_sql_running("CASE WHEN tag = 'p' AND way = 1 THEN 0 WHEN block <> 0 THEN 1 ELSE 0 END", "page_id, opened")} AS ended
              FROM (SELECT *, {_sql_running(_sql_opens('p'), 'page_id')} AS opened FROM tags)),
    bodies AS (SELECT page_id, opened, {_sql_inner(_SQL_FRAGMENT)} AS line FROM lines
               WHERE opened > 0 AND ended = 0 GROUP BY page_id, opened)
    SELECT p.page_id, p.url, coalesce(max(t.title), '') AS title,
           coalesce(string_agg(b.line, chr(10) ORDER BY b.opened) FILTER (NOT {i.sql_blank('b.line')}), '') AS content
    FROM pages p LEFT JOIN titles t ON t.page_id = p.page_id LEFT JOIN bodies b ON b.page_id = p.page_id
    GROUP BY p.page_id, p.url""")
def page_articles(spark, sf):
    return p.extract_articles(i.table(spark, sf, "pages"), _PAGE_RULE)


# list items up to their own end: where the blocks that were opened in them are all closed
_SQL_ITEMS = f"""
    {_SQL_PARTS},
    items AS (SELECT *, {_sql_running(_sql_opens('li'), 'page_id')} AS item FROM tags),
    inside AS (SELECT *, {_sql_running('block', 'page_id, item')} AS depth FROM items WHERE item > 0),
    anchors AS (SELECT *, {_sql_running(_sql_opens('a'), 'page_id, item')} AS anchor
                FROM (SELECT *, min(depth) OVER (PARTITION BY page_id, item ORDER BY n) AS least FROM inside)
                WHERE least > 0),
    texts AS (SELECT page_id, url, item, anchor, {_sql_inner(_SQL_FRAGMENT)} AS comment
              FROM (SELECT *, row_number() OVER (PARTITION BY page_id, item, anchor ORDER BY n) = 1 AS first,
                           {_sql_running("CASE WHEN tag = 'a' THEN way ELSE 0 END", "page_id, item, anchor")} AS open
                    FROM anchors WHERE anchor > 0)
              WHERE open > 0 GROUP BY page_id, url, item, anchor)"""
_ITEMS = p.CommentRule(block=p.Element("li"), text=p.Element("a"))


@query(f"""WITH {_SQL_ITEMS}
           SELECT page_id, url, CAST(item - 1 AS INTEGER) AS position, comment FROM texts WHERE anchor = 1""")
def page_records(spark, sf):
    return p.extract_comments(i.table(spark, sf, "pages"), _ITEMS)


@query(f"""WITH {_SQL_ITEMS}
           SELECT page_id, url, CAST(item - 1 AS INTEGER) AS position, CAST(anchor - 1 AS INTEGER) AS part, comment
           FROM texts WHERE NOT {i.sql_blank('comment')}""")
def page_text_records(spark, sf):
    return p.extract_comments(i.table(spark, sf, "pages"), _ITEMS, text_only=True)


@query(f"""
    WITH {_SQL_PARTS}, open AS (
        SELECT *, {_sql_running("CASE WHEN tag = 'nav' THEN way ELSE 0 END", "page_id")} AS navs,
                  {_sql_running("CASE WHEN tag = 'ul' THEN way ELSE 0 END", "page_id")} AS uls FROM tags)
    SELECT DISTINCT {_sql_resolved(_sql_reference("href"))} AS link
    FROM (SELECT url, regexp_extract(part, 'href="([^"]*)"', 1) AS href FROM open
          WHERE tag = 'a' AND way = 1 AND navs > 0 AND uls > 0)
    WHERE href <> ''""")
def page_menu_links(spark, sf):
    """Links inside a list inside a menu, by their ancestors."""
    menu = p.Element("ul", inside=(p.Element("nav"),))
    return p.extract_links(i.table(spark, sf, "pages"), "(?!)", inside=menu)


# --- records of pages that tables are written into: the tables are what comes out again ----


def _written(rows, key, *parts):
    """A page for each value of `key` with the HTML of its rows, in order of the row's place."""
    block = F.struct("place", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("html"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["html"]), "\n")
    return rows.groupBy(F.col(key).alias("page_id")).agg(
        F.concat(F.lit("<html><body><div><!-- <div class='comment-body'> -->"), html, F.lit("</div>")).alias("html")
    ).withColumn("url", F.concat(F.lit("https://voted.example.org/ru/"), "page_id"))


def _escaped(text):
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query(f"""
    SELECT conv_id AS page_id, CAST(n - 1 AS INTEGER) AS position, comment,
           CAST(length(comment) AS INTEGER) AS upvotes, CASE WHEN turn % 3 > 0 THEN CAST(turn AS INTEGER) END AS downvotes
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
                 {i.sql_strip(f"regexp_replace(text, '[{i.SPACE_CHARS}]+', ' ', 'g')")} AS comment
          FROM conversations)
    WHERE role <> 'system'""")
def voted_comments(spark, sf):
    """Comments with votes, an author required: system turns are written without one."""
    turns = i.table(spark, sf, "conversations")
    text = strip(F.regexp_replace("text", f"[{SPACE_CHARS}]+", " "))
    author = F.when(F.col("role") != "system", F.concat(F.lit("<h4 class='comment-user x'>"), "role", F.lit("</h4>")))
    rows = turns.withColumn("place", F.col("turn"))
    pages = _written(
        rows, "conv_id", '<div class="comment-body">', F.coalesce(author, F.lit("")), "<div><p>", _escaped(F.col("text")),
        "</p></div><span class=\"up-votes-count\"> ", F.length(text).cast("string"), "</span>",
        '<span class="down-votes-count">', F.when(F.col("turn") % 3 > 0, F.col("turn").cast("string")).otherwise("many"),
        "</span></div>",
    )
    return p.extract_comments(pages, p.VOTED_COMMENTS).drop("url")


@query("""
    SELECT user_id AS page_id, CAST(n - 1 AS INTEGER) AS position, event_type AS emotion,
           CASE WHEN event_id % 4 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(value) AS BIGINT) END AS count
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
    WHERE event_id % 5 > 0""")
def reaction_counters(spark, sf):
    """Reaction counters; some are no number, some have no counter element and are skipped."""
    events = i.table(spark, sf, "events").withColumn("place", F.col("event_id"))
    number = F.floor("value").cast("string")
    count = F.when(F.col("event_id") % 4 == 0, F.concat(number, F.lit("k"))).otherwise(number)
    counter = F.concat(F.lit("<b class='pc-emotions-item-counter'>\n"), count, F.lit("</b>"))
    pages = _written(
        events, "user_id", "<div title='", F.col("event_type"), "' class='pc-emotions-item on'><div>",
        F.when(F.col("event_id") % 5 > 0, counter).otherwise(""), "</div></div>",
    )
    return p.extract_reactions(pages).drop("url")
