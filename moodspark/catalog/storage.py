"""Scans, keyed maintenance and keyed outputs."""

import uuid

from pyspark.sql import functions as F

from moodspark.catalog import inputs as i
from moodspark.catalog import query
from moodspark.operators import prompts
from moodspark.operators.frames import stack
from moodspark.sources import keyed
from moodspark.sources.stored import StoredTable
from moodspark.sources.tables import (
    overwrite,
    prompt_table,
    read_csv_checked,
    read_table,
    save_stage,
    stage_root,
    write_csv,
    write_report_input,
)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def table_scan(spark, sf):
    return i.table(spark, sf, "documents")


_SQL_BASE = "SELECT doc_id AS key, source AS value, n_chars AS version FROM documents"
_SQL_DELTA = "SELECT conv_id AS key, role AS value, turn AS version FROM conversations"


def _base(spark, sf):
    return i.table(spark, sf, "documents").select(
        F.col("doc_id").alias("key"), F.col("source").alias("value"), F.col("n_chars").alias("version")
    )


def _delta(spark, sf):
    return i.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("key"), F.col("role").alias("value"), F.col("turn").alias("version")
    )


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS rn FROM ({_SQL_DELTA}))
           SELECT * FROM ({_SQL_BASE}) WHERE key NOT IN (SELECT key FROM d)
           UNION ALL SELECT key, value, version FROM d WHERE rn = 1""")
def upserted_table(spark, sf):
    return keyed.upsert(_base(spark, sf), _delta(spark, sf), ["key"], ["version"])


_SQL_LABEL_BASE = "SELECT doc_id AS key, 'label' AS value, CAST(quality AS BIGINT) AS version FROM labels"


@query(f"""WITH b AS ({_SQL_LABEL_BASE}),
                d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version) AS rn FROM ({_SQL_DELTA}))
           SELECT * FROM b
           UNION ALL SELECT key, value, version FROM d WHERE rn = 1 AND key NOT IN (SELECT key FROM b)""")
def missing_rows_inserted(spark, sf):
    base = i.table(spark, sf, "labels").select(
        F.col("doc_id").alias("key"), F.lit("label").alias("value"),
        F.col("quality").cast("bigint").alias("version"),
    )
    return keyed.insert_missing(base, _delta(spark, sf), ["key"], ["version"])


@query("""SELECT user_id AS parent, event_id AS id, event_type AS value FROM events
          WHERE user_id NOT IN (SELECT conv_id FROM conversations)
          UNION ALL SELECT conv_id, turn, role FROM conversations WHERE role = 'user'""")
def children_replaced(spark, sf):
    base = i.table(spark, sf, "events").select(
        F.col("user_id").alias("parent"), F.col("event_id").alias("id"),
        F.col("event_type").alias("value"),
    )
    turns = i.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("parent"), F.col("turn").alias("id"), F.col("role").alias("value")
    )
    return keyed.replace_children(
        base, turns.where("value = 'user'"), turns, ["parent"], spread_by=["id"]
    )


def _scratch(spark, name):
    """A new folder in the session's shared one."""
    return f"{stage_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SQL_TWO_KEYS = f"SELECT nullif(key % 7, 3) AS a, key AS b, value, version FROM"


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY version DESC, b DESC) AS rn
                      FROM ({_SQL_TWO_KEYS} ({_SQL_DELTA})))
           SELECT a, b, value, version FROM d WHERE rn = 1""")
def stored_upserts(spark, sf):
    """A stored table changed by many rows for few keys, one of them null, and by the same again."""
    table = StoredTable(spark, _scratch(spark, "stored"), "a bigint, b bigint, value string, version bigint", ["a"], 4)

    def keyed_rows(rows):
        a = F.nullif(F.col("key") % 7, F.lit(3).cast("bigint"))
        return rows.select(a.alias("a"), F.col("key").alias("b"), "value", "version")

    table.insert_missing(keyed_rows(_base(spark, sf)), ["b"])
    for _ in range(2):
        table.upsert(keyed_rows(_delta(spark, sf)), ["version", "b"])
    return table.read()


@query("""SELECT doc_id, text, lang, source, n_chars FROM documents""")
def scan_with_missing_source(spark, sf):
    """A source that is not there is an empty table."""
    absent = read_table(spark, f"{sf}/no_such_table.parquet", i.SCHEMAS["documents"], missing="empty")
    return stack(i.table(spark, sf, "documents"), absent)


@query("""SELECT conv_id, turn, role, text, CAST(NULL AS VARCHAR) AS bad_record FROM conversations
          UNION ALL SELECT NULL, NULL, NULL, NULL, event_type || ',' || CAST(event_id AS VARCHAR) || ',x,y' FROM events""")
def csv_with_bad_records(spark, sf):
    """Written as CSV and read again, among records with a text where a number belongs."""
    path = _scratch(spark, "csv")
    turns = i.table(spark, sf, "conversations")
    write_csv(turns, f"{path}/kind=good")
    wrong = i.table(spark, sf, "events").select(
        F.col("event_type").alias("conv_id"), F.col("event_id").alias("turn"), F.lit("x").alias("role"), F.lit("y").alias("text")
    )
    write_csv(wrong, f"{path}/kind=bad")
    good, bad = read_csv_checked(spark, f"{path}/kind=*", "conv_id bigint, turn bigint, role string, text string")
    return stack(good, bad.select("bad_record"))


@query("SELECT doc_id, CAST(quality + 1 AS INTEGER) AS quality, toxic FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE quality = 0")
def overwritten_partitions(spark, sf):
    """A stored table of which one partition is replaced."""
    path = _scratch(spark, "labels")
    labels = i.table(spark, sf, "labels").select("doc_id", "quality", "toxic", F.col("quality").alias("part"))
    overwrite(labels, path, ["part"])
    overwrite(labels.where("part = 1").withColumn("quality", F.col("quality") + 1), path, ["part"], only_touched=True)
    return read_table(spark, path).select("doc_id", "quality", "toxic")


@query("SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source")
def saved_stage(spark, sf):
    sizes = save_stage(i.table(spark, sf, "documents").select("source", "n_chars"), "sizes")
    return sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT role || ' ' || conv_id || ' ' || turn AS line FROM conversations")
def written_report_lines(spark, sf):
    """Lines written as text files and read again."""
    path = _scratch(spark, "report")
    turns = i.table(spark, sf, "conversations")
    place = F.concat(F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 12, "0"))
    lines = turns.select(F.col("role").alias("section"), place.alias("position"), F.concat_ws(" ", "role", "conv_id", "turn").alias("line"))
    write_report_input(lines, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT page_id, md5(url) AS id, url FROM pages")
def surrogate_keys(spark, sf):
    return keyed.with_key(i.table(spark, sf, "pages").select("page_id", "url"), "url")


@query("""SELECT sha256('post/' || CAST(user_id AS VARCHAR)) AS prompt_key,
                 'Comments: ' || CAST(count(*) AS VARCHAR) AS prompt
          FROM events JOIN documents ON doc_id = user_id GROUP BY user_id""")
def keyed_prompts(spark, sf):
    groups = prompts.post_groups(i.posts(spark, sf))
    counted = groups.withColumn(
        "prompt", F.concat(F.lit("Comments: "), F.col("comment_count").cast("string"))
    )
    return prompt_table(counted, "post_url")
