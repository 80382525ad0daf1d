"""What several operators share: tables, written stages, text keys, checked broadcasts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: A side whose rows add up to no more than this many bytes may be broadcast.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stage_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a session that names none has at least a warehouse, which is shared too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/stages-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{_stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stages(spark: SparkSession) -> None:
    """Delete what this application's stages have written, when none of their results is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stage_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _bytes(name: str, kind: T.DataType) -> Column:
    """Bytes of a value, as rows in memory hold it."""
    at = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(at)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        size = 8 * F.array_size(at)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        size = F.octet_length(F.to_json(F.struct(at)))
    else:
        size = F.lit(0)
    return 16 + F.coalesce(size, F.lit(0))


def small_enough(staged: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The same table, to be broadcast if its values add up to few bytes; else joined by shuffle."""
    row = F.lit(16).cast("long")
    for field in staged.schema:
        row = row + _bytes(field.name, field.dataType)
    found = staged.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]
    return F.broadcast(staged) if found <= limit else staged


def releasing(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow; at a task's end, memory that it has freed goes back to the system.

    Python workers live on for later tasks, and would keep what the largest of them took.
    """

    @wraps(run)
    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return ended


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores in front until the table has no such columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def lower_az(text: Column) -> Column:
    """A-Z in lower case, all else as it is.  Texts without other letters take the fast way."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fold(doc_id: Column, parts: int) -> Column:
    """The documents' fold: crc32 of the id as text, modulo parts; a missing id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
