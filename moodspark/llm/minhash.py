"""MinHash near-dedup with circulant permutations, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm.common import releasing, small_enough, stage, table
from moodspark.llm.components import components

#: 64 bands of 8 coordinates: a pair at the limit of 0.8 misses every band with a chance of
#: (1 - 0.8 ** 8) ** 64, 8 in a million; a pair at 0.4 meets in one with a chance of 0.04.
BANDS, ROWS = 64, 8
#: Pairs whose share of equal coordinates is this far below the limit are not looked up: six
#: standard deviations of the estimate from 512 coordinates at 0.8.
SLACK = 0.11
#: Classes on each side of a task that compares blocks of a band, or as many thousand shingles.
BLOCK = 4096

_WORDS_KEPT = 250_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """Hash of a word, kept for words seen before; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: bytes | None, width: int, seen: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    bytes.lower and bytes.split change and split at ASCII characters only.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    # the width goes in, so that a text of fewer words meets no shingle of a longer one
    mixed = np.full(n, width, np.uint64) * _STEP
    for k in range(width):
        mixed ^= hashes[k : k + n]
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


class Circulant:
    """Signatures from two permutations of the 32-bit numbers.

    The first scatters the shingles; the second, read from a place shifted by k around the
    circle, gives the order whose minimum is coordinate k.
    """

    def __init__(self, size: int):
        self.size = size
        self.shifts = np.arange(size, dtype=np.uint32)[:, None]
        self.width = max(1, 65_536 // size)
        self.room = np.empty((2, size, self.width), np.uint32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(self.size, 0xFFFFFFFF, np.uint32)
        places = ((hashes * _STEP) >> np.uint64(32)).astype(np.uint32)
        for start in range(0, len(places), self.width):
            part = places[start : start + self.width]
            x, y = self.room[0, :, : len(part)], self.room[1, :, : len(part)]
            np.add(part[None, :], self.shifts, out=x)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(x, np.uint32(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.minimum(least, x.min(axis=1), out=least)
        return least


def _band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for column in signature.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _sketch(signature: np.ndarray) -> bytes:
    """Four bits of every coordinate."""
    low = (signature & np.uint32(15)).astype(np.uint8)
    return (low[::2] | (low[1::2] << 4)).tobytes()


def _equal_places(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many coordinates sketches agree, along the last axis."""
    other = x ^ y
    return np.count_nonzero(other & 15 == 0, axis=-1) + np.count_nonzero(other >> 4 == 0, axis=-1)


def _places_needed(share: float) -> float:
    """Coordinates that agree if the share of equal ones is this; one in 16 of the others looks so."""
    return BANDS * ROWS * (share + (1 - share) / 16)


SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, circulant = WordHashes(), Circulant(BANDS * ROWS)
        for batch in batches:
            for part in _pieces(batch):
                counts, digests, bands, sketches = [], [], [], []
                for text in part.column(1).cast(pa.large_binary()).to_pylist():
                    found = shingles(text, width, seen)
                    counts.append(len(found))
                    if not len(found):
                        digests.append(None), bands.append(None), sketches.append(None)
                        continue
                    signature = circulant(found)
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    bands.append(_band_keys(signature))
                    sketches.append(_sketch(signature))
                yield pa.record_batch(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands", "sketch"],
                )

    return run


def _pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that only a few texts at a time are Python objects."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for batch in batches:
            for part in _pieces(batch):
                sets = [
                    shingles(text, width, seen).tobytes() for text in part.column(1).cast(pa.large_binary()).to_pylist()
                ]
                yield pa.record_batch(
                    [part.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "held"]
                )

    return run


def _close(least: float):
    """Pairs whose sketches agree in at least this share of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                _equal_places(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) >= _places_needed(least)
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(percent: int):
    """Pairs whose whole sets overlap enough: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = 0
                    if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                        both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class Block:
    """Classes of one band as arrays: ids, component labels, sketches and the keys of all their bands."""

    def __init__(self, rows: pa.Table):
        self.ids, self.own = rows["doc_id"].to_numpy(), rows["own"].to_numpy().copy()
        self.sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.bands = pc.list_flatten(rows["bands"]).to_numpy().reshape(len(self.ids), BANDS)

    def close_to(self, other: Block, i: int, label: int, band: int, least: float) -> np.ndarray:
        """Rows that class i of another block may link with, and whose first shared band is this one.

        Those have another label than `label`, and their sketches agree in at least this share of places.
        """
        near = _equal_places(self.sketches, other.sketches[i]) >= _places_needed(least)
        at = np.flatnonzero(near & (self.own != label))
        shared = self.bands[at] == other.bands[i]
        return at[self.bands[at, shared.argmax(axis=1)] == band]


OPEN = "band long, block long, part long, doc_id long"


def _apart(least: float):
    """Classes of a block of strays and a block of a band that may link with one of the other side.

    A class comes out once, however many it may link with.
    """

    def run(keys, strays, there):
        found = np.empty(0, np.int64)
        if strays.num_rows and there.num_rows:
            few, many = Block(strays), Block(there)
            wanted = np.zeros(len(many.ids), bool)
            alone = np.zeros(len(few.ids), bool)
            for i in range(len(few.ids)):
                at = many.close_to(few, i, few.own[i], keys[0].as_py(), least)
                wanted[at] = True
                alone[i] = len(at) > 0
            found = np.union1d(few.ids[alone], many.ids[wanted])
        return pa.table(
            {k: pa.array([key.as_py()] * len(found), pa.int64()) for k, key in zip(("band", "block", "part"), keys, strict=True)}
            | {"doc_id": found}
        )

    return run


def _joined(percent: int, least: float):
    """Links among the classes of a task that join components: no more than there are classes.

    Pairs are confirmed on full sets here, and pairs of classes that other links have joined
    already are passed over, so neither refuted nor needless pairs become rows.
    """

    def run(keys, rows):
        band, block = keys[0].as_py(), Block(rows)
        sets = [np.frombuffer(x, np.uint64) for x in rows["held"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        code = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        there = np.zeros(code.max() + 1, bool)
        a, b = [], []
        for i in range(len(sets)):
            at = block.close_to(block, i, block.own[i], band, least)
            at = at[at > i]
            at = at[100 * np.minimum(sizes[at], sizes[i]) >= percent * np.maximum(sizes[at], sizes[i])]
            if not len(at):
                continue
            mine = code[starts[i] : starts[i + 1]]
            there[mine] = True
            both = np.array([np.count_nonzero(there[code[starts[k] : starts[k + 1]]]) for k in at])
            there[mine] = False
            for k in at[100 * both >= percent * (sizes[at] + sizes[i] - both)]:
                if block.own[k] != block.own[i]:
                    a.append(max(block.ids[i], block.ids[k]))
                    b.append(min(block.ids[i], block.ids[k]))
                    block.own[block.own == block.own[k]] = block.own[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Documents link if 100 * |A & B| >= percent * |A | B| for their sets A, B of distinct shingles
    of `width` words (runs of anything but ASCII white space, A-Z in lower case).  With fewer
    words the whole sequence is the one shingle; without words the set is empty and links with
    nothing.  component_id is the smallest doc_id reachable by links; kept is doc_id =
    component_id.

    Documents with the same set become one class before banding, so exact copies cost nothing
    more.  The classes that meet in a band link in three rounds, each on what the one before left
    apart: with the smallest class of all their bands; with one class of each band, picked by a
    hash; and in bands that still hold several components, every class outside the band's largest
    component with the classes of other components, block by block.  There, sketches tell which
    classes have a partner near the limit; their full sets go to the block's task, which gives back
    links that join components, so no more rows than it has classes.  Blocks have a bound in classes and
    in shingles.  So a group of thousands of near copies costs a few rows for each copy, not all
    pairs.  Every pair is confirmed on full sets.

    Rows without doc_id link with nothing: component_id null, kept true.  Repeated rows of one
    doc_id are one document with the links of all its rows; each row is returned.  Extra columns
    are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(docs.mapInArrow(releasing(_sign(width)), SIGNED), "signatures")
    classes = (
        signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class"))
    )
    classes = stage(classes, "classes")
    heads = signed.select("doc_id", "digest", "bands", "sketch", "n_shingles").join(
        classes.select("digest", F.col("class").alias("doc_id")), ["digest", "doc_id"], "left_semi"
    )
    buckets = heads.select("doc_id", F.explode("bands").alias("band")).distinct()
    shared = buckets.groupBy("band").agg(
        F.min("doc_id").alias("hub"),
        F.min_by("doc_id", F.xxhash64("doc_id", "band")).alias("other"),
        F.count("*").alias("n"),
    )
    members = stage(buckets.join(shared.where("n > 1"), "band"), "members")

    found = members.select("doc_id").distinct()
    ids = small_enough(stage(found, "candidates"))
    sketches = stage(heads.join(ids, "doc_id", "left_semi").select("doc_id", "sketch", "bands", "n_shingles"), "sketches")
    sets = stage(docs.join(ids, "doc_id", "left_semi").mapInArrow(releasing(_sets(width)), "doc_id long, held binary"), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), each once, that are links."""
        close = _with_both(stage(pairs, "pairs"), sketches, "sketch").mapInArrow(
            _close(percent / 100 - SLACK), "a long, b long"
        )
        close = stage(close.distinct(), "close")
        return stage(_with_both(close, sets, "held").mapInArrow(_alike(percent), "a long, b long").distinct(), "links")

    links = linked(members.where("doc_id <> hub").groupBy("doc_id").agg(F.min("hub").alias("hub")).toDF("a", "b"))
    label = stage(components(links), "labels")

    own, hubs = label.toDF("doc_id", "own"), label.toDF("other", "theirs")
    named = members.drop("n").join(own, "doc_id", "left").join(hubs, "other", "left")
    named = named.withColumns({"own": F.coalesce("own", "doc_id"), "theirs": F.coalesce("theirs", "other")})
    links = links.unionByName(
        linked(named.where("own <> theirs").select(F.col("doc_id").alias("a"), F.col("other").alias("b")).distinct())
    )
    label = stage(components(links), "labels")

    # a band of two classes has been compared whole
    own = label.toDF("doc_id", "own")
    weights = sketches.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(1.0), F.col("n_shingles") / 1000)).alias("weight"))
    named = members.where("n > 2").join(own, "doc_id", "left").select("band", "doc_id", F.coalesce("own", "doc_id").alias("own"))
    named = stage(named.join(weights, "doc_id"), "named")
    sizes = named.groupBy("band", "own").agg(F.sum("weight").alias("n"))
    main = sizes.groupBy("band").agg(
        F.max_by("own", F.struct("n", "own")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("labels")
    )
    main = main.where("labels > 1").select(
        "band",
        "main",
        F.ceil(F.col("n") / BLOCK).alias("blocks"),
        F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("few"),
    )
    open_bands = stage(named.join(main, "band").join(sketches.drop("n_shingles"), "doc_id"), "open")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    few = F.pmod(F.xxhash64("doc_id"), F.col("few"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["band", "block", "part"]
    kept = ["doc_id", "own", "sketch", "bands"]
    strays = open_bands.where("own <> main").select("band", every("blocks").alias("block"), few.alias("part"), *kept)
    there = open_bands.select("band", block.alias("block"), every("few").alias("part"), *kept)
    least = percent / 100 - SLACK
    wanted = strays.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(_apart(least), OPEN)
    wanted = stage(wanted, "near")
    near = wanted.join(open_bands.select("band", *kept), ["band", "doc_id"]).join(sets, "doc_id")
    rest = stage(near.groupBy(*keys).applyInArrow(_joined(percent, least), "a long, b long").distinct(), "links")
    links = links.unionByName(rest)
    label = components(links).toDF("class", "component")

    held = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "digest").join(classes, "digest")
    held = held.join(label, "class", "left").select("doc_id", F.coalesce("component", "class").alias("component"))
    final = stage(held.groupBy("doc_id").agg(F.min("component").alias("low"), F.max("component").alias("high")), "held")
    split = final.where("low <> high")
    if split.isEmpty():
        final = final.select("doc_id", F.col("low").alias("component_id"))
    else:  # repeated rows of one doc_id with different texts: the document joins their components
        bridges = held.join(split.select("doc_id", "low"), "doc_id").select("low", "component")
        joined = components(bridges, "low", "component").toDF("low", "joined")
        final = final.join(joined, "low", "left").select("doc_id", F.coalesce("joined", "low").alias("component_id"))
    return (
        signed.select("doc_id", "n_shingles")
        .join(final, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _with_both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """a, b and the values of both."""
    first = values.select(F.col("doc_id").alias("a"), F.col(name).alias("x"))
    second = values.select(F.col("doc_id").alias("b"), F.col(name).alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)
