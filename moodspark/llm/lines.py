"""Line dedup: lines that many documents share are kept in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm.common import ASCII_SPACE, lower_az, small_enough, stage, table, unused


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(line: Column, min_chars: int) -> Column:
    """Digest of the line's key, null if the key is shorter than min_chars code points."""
    key = lower_az(F.btrim(line, F.lit(ASCII_SPACE)))
    return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key.cast("binary"))))


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """docs with `text` reduced to the lines that stay, and n_lines and n_dropped.

    A line's key is the line stripped of ASCII white space, A-Z in lower case.  Keys of at least
    min_chars code points that min_docs documents hold lose all their lines except those of the
    largest doc_id that holds the key.  What stays is joined by newlines in its old order.

    Lines are compared by digest; the digests of each document are written once and read for
    the counts and for the lookup.  Counts combine before their shuffle, so a line of every
    document is no hot task.  The lines to drop are written too: few bytes of them are broadcast, more
    meet the digests in a join that adaptive execution can split.  Texts move only for the last
    join, by document.

    Null or empty text is one empty line.  Rows without doc_id are not counted and keep all
    lines.  Repeated rows of one doc_id count as one document and all lose the same lines.
    Columns n_lines and n_dropped of the input are replaced; other extra columns stay, whatever
    their names.
    """
    docs = docs.drop("n_lines", "n_dropped")
    of, gone, stays = unused(docs, "of_doc", "lost_lines", "lines_that_stay")
    digests = F.array_distinct(F.array_compact(F.transform(_lines(F.col(text)), lambda x: _digest(x, min_chars))))
    held = stage(
        docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.explode(digests).alias("line")),
        "lines",
    )
    often = (
        held.groupBy("line")
        .agg(F.countDistinct("id").alias("n"), F.max("id").alias("last"))
        .where(F.col("n") >= min_docs)
        .select("line", "last")
    )
    lost = (
        held.join(small_enough(stage(often, "often")), "line")
        .where("id <> last")
        .groupBy("id")
        .agg(F.collect_set("line").alias(gone))  # at most the lines of one document
        .withColumnRenamed("id", of)
    )
    lines = _lines(F.col(text))
    stay = F.when(F.col(gone).isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.coalesce(F.array_contains(gone, _digest(x, min_chars)), F.lit(False)))
    )
    joined = docs.join(lost, F.col(doc_id) == F.col(of), "left")
    kept = joined.withColumn(stays, stay).withColumn("n_lines", F.size(lines).cast("long"))
    return kept.select(
        *[F.array_join(stays, "\n").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns],
        "n_lines",
        (F.col("n_lines") - F.size(stays)).alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos
  FROM documents,
       LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) u
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), often AS (
  SELECT key, max(doc_id) AS last FROM keyed
  WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE o.key IS NOT NULL AND o.last <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (WHERE o.key IS NULL OR o.last = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key
GROUP BY k.doc_id
"""
