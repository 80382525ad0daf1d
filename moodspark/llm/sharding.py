"""Sharding by jump consistent hashing: a stable key and the number of shards give the shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from moodspark.llm.common import small_enough, stage, table

#: The method's constants: the multiplier of its 64-bit generator and the 31 bits it draws.
MULTIPLIER, DRAWN = 2862933555777941757, 1 << 31

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key.  A key leaps from shard to shard until the next leap is past the end."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    left = np.arange(len(state))
    leap = np.zeros(len(state), np.int64)
    while len(left):
        at[left] = leap
        state[left] = state[left] * np.uint64(MULTIPLIER) + np.uint64(1)
        drawn = (state[left] >> np.uint64(33)).astype(np.float64) + 1.0
        after = (leap + 1).astype(np.float64) * (DRAWN / drawn)
        inside = after < shards
        left, leap = left[inside], after[inside].astype(np.int64)
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 to shards - 1 of a bigint key; a null key has the shard of 0."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.arrow_udf("int")
    def shard(keys: pa.Array) -> pa.Array:
        return pa.array(jump(keys.fill_null(0).to_numpy(zero_copy_only=False), shards), pa.int32())

    return shard(key)


def stable_key(df: DataFrame, *columns: str) -> Column:
    """One integer column as it is; anything else by a hash of its values."""
    if len(columns) == 1 and isinstance(df.schema[columns[0]].dataType, INTEGERS):
        return df[columns[0]].cast("bigint")
    return F.xxhash64(*[df[c] for c in columns])


def assign(df: DataFrame, shards: int, *keys: str, to: str = "shard") -> DataFrame:
    """df with the shard of each row in column `to`, which replaces one of that name.

    Only the keys and the number of shards decide, not the other rows: a run over half of the
    rows, or in another order, gives the same.  With one more shard a row stays or goes to the
    new one, a share of 1 / (shards + 1) of the keys.  Rows with equal keys share a shard, so a
    repeated key loads its shard, and null keys do.  No shuffle.
    """
    shard = shard_of(stable_key(df, *keys), shards)
    return df.select(*[df[c] for c in df.columns if c != to], shard.alias(to))


def moved(df: DataFrame, before: int, after: int, *keys: str) -> DataFrame:
    """The rows that change their shard when shards are appended, with columns `shard` and `to_shard`."""
    if after < before:
        raise ValueError("shards are only appended")
    placed = assign(assign(df, before, *keys), after, *keys, to="to_shard")
    return placed.where("shard <> to_shard")


def with_slots(df: DataFrame, order: list[str], shard: str = "shard", to: str = "slot") -> DataFrame:
    """df with each row's place in its shard, gapless from 0, by the `order` columns (nulls first).

    Rows that are equal in all of them take the next places in any order.  Rows are
    range-partitioned by shard, order and a row number of the written input, so neither a large
    shard nor a third of all rows with one key is one task.  Each task numbers its own rows, and
    the number of rows that earlier tasks hold of a shard is added: a row for each task and shard.
    A column `to` of the input is replaced; others stay, whatever their names.
    """
    columns = [c for c in df.columns if c != to]
    names = [f"c{k}" for k in range(len(columns))]  # short names of our own cannot clash
    by = [f"c{columns.index(c)}" for c in (shard, *order)]
    rows = stage(df.select(*columns).toDF(*names).withColumn("row", F.monotonically_increasing_id()), "slots")
    dealt = rows.repartitionByRange(*by, "row").sortWithinPartitions(*by, "row").drop("row")
    # the number of the partition in the upper bits, the place in it in the lower 33
    numbered = stage(dealt.withColumn("at", F.monotonically_increasing_id()), "slots")
    part = F.shiftright("at", 33).alias("part")
    held = numbered.groupBy(F.col(by[0]).alias("of"), part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    held = small_enough(stage(held.select("of", "part", F.expr("before - first AS shift")), "slots"))
    keyed = numbered.withColumn("part", part)
    placed = keyed.join(held, (keyed[by[0]].eqNullSafe(held["of"])) & (keyed["part"] == held["part"]))
    return placed.select(
        *[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)], F.expr("at + shift").alias(to)
    )


def write_shards(placed: DataFrame, path: str, rows_in_file: int = 1_000_000, shard: str = "shard", slot: str = "slot"):
    """Parquet folders shard=0, shard=1, ...; a shard is dealt over tasks by slot, a file holds at most so many rows."""
    block = F.floor(F.col(slot) / rows_in_file)
    placed.repartition(shard, block).sortWithinPartitions(shard, slot).write.partitionBy(shard).option(
        "maxRecordsPerFile", rows_in_file
    ).parquet(path)


def place_documents(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more) of every document.

    size is the text's UTF-8 bytes plus 1; null text counts as no bytes.  Documents without
    doc_id have the shard of key 0.  Repeated rows share a shard and take a slot each.  An empty
    table gives no rows; extra columns are left out.
    """
    key = stable_key(docs, doc_id)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        shard_of(key, shards).alias("shard"),
        shard_of(key, shards + 1).alias("grown_shard"),
    )
    placed = with_slots(placed, ["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)


# 64-bit wrap-around by remainders of 128-bit integers; the checksum takes a table made by its rule.
OP12_SQL = r"""
WITH RECURSIVE crc_bits AS (
  SELECT b AS code, b::UBIGINT AS crc, 0 AS k FROM range(256) r(b)
  UNION ALL
  SELECT code, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::UBIGINT) ELSE crc >> 1 END, k + 1
  FROM crc_bits WHERE k < 8
), crc_table AS (SELECT list(crc ORDER BY code) AS of FROM crc_bits WHERE k = 8
), texts AS (
  SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents
), bytes AS (
  SELECT doc_id, octet_length(body) + 1 AS size, of,
         list_concat([4294967295::UBIGINT], list_transform(regexp_extract_all(hex(body), '..'),
           lambda b: ('0x' || b)::UBIGINT)) AS codes
  FROM texts, crc_table
), summed AS (
  SELECT doc_id, size, xor(list_reduce(codes, lambda crc, b:
           xor(crc >> 8, of[((xor(crc, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM bytes
), leaps AS (
  SELECT n, doc_id, (coalesce(doc_id, 0) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS state,
         -1::BIGINT AS here, 0::BIGINT AS leap
  FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (8), (9)) c(n)
  UNION ALL
  SELECT n, doc_id, next, leap,
         floor((leap + 1)::DOUBLE * (2147483648::DOUBLE / ((next // 8589934592::HUGEINT)::DOUBLE + 1)))::BIGINT
  FROM (SELECT n, doc_id, leap,
               (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS next
        FROM leaps WHERE leap < n)
), placed AS (
  SELECT n, doc_id, max(here)::INTEGER AS shard FROM leaps GROUP BY n, doc_id
)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, a.shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY s.doc_id NULLS FIRST, s.size, s.text_crc32) - 1 AS slot,
       b.shard AS grown_shard
FROM summed s
JOIN placed a ON a.n = 8 AND a.doc_id IS NOT DISTINCT FROM s.doc_id
JOIN placed b ON b.n = 9 AND b.doc_id IS NOT DISTINCT FROM s.doc_id
"""
