"""Quality by compression: dictionaries of good and of bad text, and which of them fits better."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm.common import fold, table
from moodspark.llm.fit import SAMPLE_ROWS, labelled_sample, logistic, probability

#: Texts are compressed in blocks of this many bytes, so that a long text is judged by the
#: dictionaries all through, not by what it has said before.
BLOCK = 4096
#: Bytes of a dictionary, and of the sample blocks that one is trained on, at most.
DICTIONARY, TRAINING = 112_640, 12_000_000
LEVEL = 3


def blocks(text: bytes) -> list[bytes]:
    return [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]


class Sizes:
    """Compressed bytes of a text with the good, the bad and no dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        with_ = lambda d: zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO), **plain
        )
        self.all = [with_(good), with_(bad), zstandard.ZstdCompressor(**plain)]

    def __call__(self, text: bytes) -> tuple[int, int, int]:
        parts = blocks(text)
        good, bad, none = (sum(len(c.compress(x)) for x in parts) for c in self.all)
        return good, bad, none


def normalised(sizes: tuple[int, int, int], length: int) -> tuple[float, float]:
    """What the good dictionary saves over the bad one, as a share of both sizes; and the share of the
    text that compression without dictionary leaves.  Nothing for an empty text."""
    good, bad, none = sizes
    return ((bad - good) / (bad + good), none / length) if length else (0.0, 0.0)


@dataclass
class Compression:
    """A fitted model: two dictionaries and the weights that calibrate the difference."""

    good: bytes = b""
    bad: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])


def _dictionary(sample: DataFrame, label: int) -> bytes:
    """A dictionary of blocks of the texts with this label, at most TRAINING bytes of them.

    Texts are cut in the executors, whole; of their distinct blocks so many as the bound allows come
    to the driver, in the order of a hash.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.slice(at, 256).column(0).to_pylist()
                parts = list(dict.fromkeys(x for t in texts for x in blocks(t.encode())))
                yield pa.record_batch([pa.array(parts, pa.binary())], names=["part"])

    # a copy teaches nothing new
    parts = sample.where(F.col("label") == label).select("text").mapInArrow(cut, "part binary").distinct()
    parts = parts.orderBy(F.xxhash64("part"), "part").limit(TRAINING // BLOCK)
    found = [bytes(r["part"]) for r in parts.collect()]
    if len(found) < 8 or sum(map(len, found)) < 4096:
        return b"".join(found)[-DICTIONARY:]
    try:
        size = min(DICTIONARY, sum(map(len, found)) // 4)
        return zstandard.train_dictionary(size, found, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too little in common: the text itself serves as one
        return b"".join(found)[-DICTIONARY:]


def _design(measured: np.ndarray) -> np.ndarray:
    """difference, share left, and its square."""
    return np.column_stack([100 * measured[:, 0], measured[:, 1], measured[:, 1] ** 2])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> Compression:
    """The model, from at most `rows` labelled rows outside the held-out fold.

    Half of them train the dictionaries, the other half calibrate: a dictionary knows its own texts
    too well to tell how it does on others.
    """
    sample = labelled_sample(docs, labels, "quality", folds, held_out, rows)
    half = F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2))  # copies fall into one half
    train, rest = sample.where(half == 0), sample.where(half == 1)
    good, bad = _dictionary(train, 1), _dictionary(train, 0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            x = [normalised(sizes(t), len(t)) for t in texts]
            yield pa.record_batch(
                [batch.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())],
                names=["label", "x", "y"],
            )

    # a row for each distinct text: a group of copies counts once
    once = rest.groupBy("text").agg(F.max("label").alias("label")).select("label", "text")
    # a few numbers for each row of the sample, in an order that does not depend on tasks
    rows_of = once.mapInArrow(measure, "label int, x double, y double").collect()
    measured = np.array(sorted(map(tuple, rows_of)), float).reshape(-1, 3)
    return Compression(good, bad, logistic(_design(measured[:, 1:]), measured[:, 0]).tolist())


def score(docs: DataFrame, model: Compression) -> DataFrame:
    """doc_id, score, predicted of every row's whole text; null text is empty.

    Only the text goes into the score.  Rows without doc_id are scored too, repeated rows each, with
    equal scores.  Extra columns are not read.  An empty table gives no rows.
    """
    good, bad, weights = model.good, model.bad, np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or b"" for t in part.column(1).cast(pa.large_binary()).to_pylist()]
                x = np.array([normalised(sizes(t), len(t)) for t in texts]).reshape(-1, 2)
                p = probability(_design(x), weights)
                yield pa.record_batch(
                    [part.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())],
                    names=["doc_id", "score", "predicted"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
