"""Reading and writing tables."""

import os
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH_NOT_FOUND = "PATH_NOT_FOUND"


def read_table(
    spark: SparkSession, path: str, schema: str | None = None, missing: str = "error"
) -> DataFrame:
    """Parquet table.  ``missing='empty'`` turns an absent path into an empty typed table."""
    if missing not in ("error", "empty"):
        raise ValueError(f"missing must be 'error' or 'empty', not {missing!r}")
    if missing == "empty" and schema is None:
        raise ValueError("an empty table needs a schema")
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if missing == "empty" and e.getCondition() == PATH_NOT_FOUND:
            return spark.createDataFrame([], schema)
        raise


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("_probe string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == PATH_NOT_FOUND:
            return False
        raise
    return True


def overwrite(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), only_touched: bool = False
) -> None:
    """Replace a table, or with ``only_touched`` just the partitions that occur in ``df``."""
    writer = df.write.mode("overwrite")
    if only_touched:
        if not partition_by:
            raise ValueError("only_touched needs partition_by")
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header row; null and '' stay different; spaces and line breaks in text survive."""
    df.write.mode("overwrite").csv(
        path,
        header=True,
        quote='"',
        escape='"',
        emptyValue='""',
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


_CSV = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "\0",  # any text that does not occur: keeps a quoted "" apart from nothing
    "enforceSchema": False,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, **_CSV)


def read_csv_checked(spark: SparkSession, path: str, schema: str, bad: str = "bad_record") -> tuple[DataFrame, DataFrame]:
    """The records that fit the schema, and as text in column ``bad`` those that do not.

    A record does not fit if it has too few or too many fields, or one that is not of its type.
    The files are parsed once, into a written table that both parts are read from, so each record
    is in one of the two.
    """
    read = spark.read.schema(f"{schema}, {bad} string").csv(
        path, mode="PERMISSIVE", columnNameOfCorruptRecord=bad, **_CSV
    )
    read = save_stage(read.withColumn("_file", F.input_file_name()), "csv")
    fits = F.col(bad).isNull()
    return read.where(fits).drop(bad, "_file"), read.where(~fits).select(bad, F.col("_file").alias("file"))


def stage_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir, or else its warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def save_stage(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Write an intermediate result and read it back.

    The written table cuts the lineage: losing an executor later never repeats the work
    before it, such as model calls, and every later reader sees the same rows.
    """
    spark = df.sparkSession
    path = os.path.join(root or stage_root(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prompt_table(prompts: DataFrame, key: str, prompt: str = "prompt") -> DataFrame:
    """One text per group under a stable name: the same group has the same name in every run."""
    return prompts.select(
        F.sha2(F.col(key).cast("string"), 256).alias("prompt_key"), F.col(prompt).alias("prompt")
    )


def write_prompts(prompts: DataFrame, path: str, key: str, prompt: str = "prompt") -> None:
    """Many small texts go into few parquet files rather than one file each."""
    overwrite(prompt_table(prompts, key, prompt), path)


def write_report_input(lines: DataFrame, path: str) -> None:
    """Text files whose names sort in line order.

    A range sort on (section, position) lets any number of lines be written in parallel:
    part-00000 holds the first lines, the last part the last ones.
    """
    lines.orderBy("section", "position").select("line").write.mode("overwrite").text(path)
