"""Best-fit packing of token pieces into sequences, improved by swaps between bins."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moodspark.llm.common import give_back, releasing, stage, table

#: Characters after which a longer text is cut, so that only a part's ids at a time are Python objects.
PART = 1 << 16
#: White space in one run that the fast encoder is given at most; its pattern looks ahead from every place of it.
SPACE_RUN = 50_000
_SPACES = re.compile(r"\s{2,}")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Rounds of packing at most, which keeps sequence_id within its bits, and how many shards' rows meet
#: in one task after the first.
ROUNDS, MEET = 63, 3


class Encoder:
    """Token ids of a text as the tokenizer file gives them, as little-endian 32-bit numbers.

    The file's vocabulary runs on a faster byte-pair encoder, which gets whole texts: with many
    different words, a call for each word that is not remembered takes longer than the text at once.
    A space between two characters that are not white space always begins a new pretoken, so long
    texts are cut at such a one.  Texts that hold the special token's string, or white space in
    very long runs, go to the file's own tokenizer, which is read when the first of them comes.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        back = _byte_of_symbol()
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    @cached_property
    def file(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        long = len(text) > SPACE_RUN and any(m.end() - m.start() > SPACE_RUN for m in _SPACES.finditer(text))
        if long or any(x in text for x in self.special):
            return _little(self.file.encode(text, add_special_tokens=False).ids)
        return b"".join(_little(self.fast.encode_ordinary(x)) for x in _cut(text))


def _cut(text: str) -> Iterator[str]:
    """The text in parts of PART characters or somewhat more; where no lone space is left, the rest is one part."""
    start = 0
    while len(text) - start > PART and (found := _LONE_SPACE.search(text, start + PART)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _little(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _byte_of_symbol() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids: the tokens of every whole text, then the end token.

    ids holds little-endian unsigned 32-bit numbers.  A document of more than `size` tokens is
    cut into pieces of that many, of which the first may be shorter.  Null text is empty: one
    piece with the end token.  A row without doc_id is tokenised under the null id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = Encoder(tokenizer), _little([end])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, pieces, starts, lengths, held = [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    tokens = encode(text or "") + last
                    n = len(tokens) // 4
                    cuts = [0, *range(n % size or min(n, size), n, size), n]
                    for k in range(len(cuts) - 1):
                        ids.append(doc_id)
                        pieces.append(k)
                        starts.append(cuts[k])
                        lengths.append(cuts[k + 1] - cuts[k])
                        held.append(tokens[4 * cuts[k] : 4 * cuts[k + 1]])
                yield pa.record_batch(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(pieces, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(held, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(releasing(run), PIECES)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: the longest item first, each into the fullest bin that takes it."""
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms: list[int] = []  # rooms that some bin has, ascending
    bins: list[list[int]] = []
    for k in order:
        need = lengths[k]
        at = bisect_left(rooms, need)
        if at == len(rooms):
            bins.append([k])
            b, room = len(bins) - 1, size
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(k)
        left = room - need
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return bins


class _Donors:
    """Items and pairs of items of the emptiest bins, found by their length."""

    def __init__(self, size: int):
        self.size = size
        self.by_length: list[dict] = [{} for _ in range(size + 1)]
        self.present = 0  # bit n: something of length n is there

    def _entries(self, b: int, items: list[int], lengths: list[int]):
        for x, k in enumerate(items):
            yield lengths[k], (b, k, -1)
            for j in items[x + 1 :]:
                yield lengths[k] + lengths[j], (b, k, j)

    def add(self, b: int, items: list[int], lengths: list[int]) -> None:
        for n, entry in self._entries(b, items, lengths):
            self.by_length[n][entry] = None
            self.present |= 1 << n

    def remove(self, b: int, items: list[int], lengths: list[int]) -> None:
        for n, entry in self._entries(b, items, lengths):
            self.by_length[n].pop(entry, None)
            if not self.by_length[n]:
                self.present &= ~(1 << n)

    def longest(self, most: int) -> tuple[int, tuple[int, int, int] | None]:
        """The longest entry of at most this length."""
        n = (self.present & ((1 << (min(most, self.size) + 1)) - 1)).bit_length() - 1
        return (n, next(reversed(self.by_length[n]))) if n > 0 else (0, None)


def swap_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Exchange items between underfull bins while that raises the sum of squared fills.

    The emptiest twentieth of the underfull bins are donors.  Every fuller bin takes from them
    what fills it best: a move (one or two items for nothing), one for one, or two for one of its
    own.  Each step makes a fuller bin fuller and an emptier one emptier, so squared fill rises and
    the search ends.  Donors left with nothing go.  Passes go on while they empty bins.
    """
    done = [b for b in bins if sum(lengths[k] for k in b) == size]
    held = {n: list(b) for n, b in enumerate(bins) if sum(lengths[k] for k in b) < size}
    fill = {n: sum(lengths[k] for k in b) for n, b in held.items()}
    while len(held) > 1:
        order = sorted(held, key=lambda n: (fill[n], n))
        few = max(1, len(order) // 20)
        donors = _Donors(size)
        for n in order[:few]:
            donors.add(n, held[n], lengths)
        for n in reversed(order[few:]):
            while fill[n] < size:
                room = size - fill[n]
                gain, give, found = 0, -1, None
                for j in (-1, *held[n]):
                    own = lengths[j] if j >= 0 else 0
                    length, entry = donors.longest(own + room)
                    if entry and length - own > gain:
                        gain, give, found = length - own, j, entry
                        if gain == room:
                            break
                if found is None:
                    break
                d, *taken = found
                taken = [k for k in taken if k >= 0]
                donors.remove(d, held[d], lengths)
                held[d] = [k for k in held[d] if k not in taken] + ([give] if give >= 0 else [])
                held[n] = [k for k in held[n] if k != give] + taken
                fill[n] += gain
                fill[d] -= gain
                if held[d]:
                    donors.add(d, held[d], lengths)
                else:
                    del held[d], fill[d]
            if fill[n] == size:
                done.append(held.pop(n))
                del fill[n]
        if not any(n not in held for n in order[:few]):
            break
    return done + list(held.values())


def _pack(size: int, at: int):
    """Packs one shard; `at` is the place of the length among the columns, the last of which is the shard."""

    def run(keys, group):
        lengths = group.column(at).to_pylist()
        bins = swap_search(best_fit(lengths, size), lengths, size)
        number, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for b, items in enumerate(bins):
            place = 0
            for k in items:
                number[k], offset[k] = b, place
                place += lengths[k]
            fill[items] = place
        number = (number << 32) + keys[0].as_py()
        give_back()
        columns = [*group.columns[:-1], pa.array(number), pa.array(offset), pa.array(fill)]
        return pa.table(columns, names=[*group.column_names[:-1], "bin", "place", "fill"])

    return run


def pack(pieces: DataFrame, size: int = 1024, shard: int = 20_000) -> DataFrame:
    """pieces, which have a `length` of 1 to size, with sequence_id and offset.

    Pieces of `size` are sequences of their own.  The others are dealt by a hash of their number in the
    table into shards of about `shard` pieces, packed by best fit and improved by swaps (see
    swap_search), each shard in one task.  The pieces of sequences that are not full are dealt anew
    in the next round, MEET shards' rows to a task.  Rounds end when one task held all that was
    left, or when a round made hardly fewer sequences (less than a hundredth) of its pieces than
    they filled before; its sequences stay as they are.  So no task holds much more than MEET shards'
    rows, whatever document or length they are of.

    Repeated rows are all placed, and dealt apart like others.  Columns sequence_id and offset of the
    input are replaced, all others are carried, whatever their names.  An empty table gives no
    rows.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    short = [f"c{k}" for k in range(len(names))]  # short names of our own cannot clash
    pieces = pieces.select(*names).toDF(*short).withColumn("row", F.monotonically_increasing_id())
    at = names.index("length")
    length = F.col(short[at])
    whole = pieces.where(length >= size)
    done = [whole.select(*short, F.col("row").alias("bin"), F.lit(0).cast("long").alias("place"))]
    left = pieces.where(length < size)
    n, rounds = left.count(), 0
    parts = max(1, -(-n // shard))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    before = None  # sequences that the pieces of this round filled in the one before
    while n:
        dealt = left.withColumn("shard", F.pmod(F.xxhash64(F.lit(rounds), "row"), F.lit(parts).cast("long")))
        packed = stage(
            dealt.groupBy("shard").applyInArrow(_pack(size, at), f"{kinds}, bin long, place long, fill long"),
            "packed",
        )
        first, is_open = F.col("place") == 0, F.col("fill") < size
        bins, open_bins, n = packed.agg(F.count_if(first), F.count_if(first & is_open), F.count_if(is_open)).first()
        last = parts == 1 or rounds == ROUNDS - 1 or (before is not None and (before - bins) * 100 < before)
        over = packed if last else packed.where(~is_open)
        done.append(over.select(*short, "bin", "place"))
        if last:
            break
        left = packed.where(is_open).select(*short, "row")
        before, parts, rounds = open_bins, max(1, -(-n // (MEET * shard))), rounds + 1
    out = None
    for k, x in enumerate(done):  # each round numbers its bins apart from the others
        x = x.select(
            *[F.col(c).alias(name) for c, name in zip(short, names, strict=True)],
            (F.col("bin") * (ROUNDS + 1) + k).alias("sequence_id"),
            F.col("place").alias("offset"),
        )
        out = x if out is None else out.unionByName(x)
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, size: int = 1024, end: int = 2, digest: bool = False
) -> DataFrame:
    """token_pieces with their places: sequence_id and offset, gapless from 0 in each sequence.

    With digest, ids_crc32 stands in for the ids, so that only numbers are written and moved.
    """
    pieces = token_pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), size, end)
    if digest:
        pieces = pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
    return pack(stage(pieces, "pieces"), size)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), digest=True)
