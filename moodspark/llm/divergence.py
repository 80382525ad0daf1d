"""Source divergence audit: how far the words of each source are from those of the others.

Counts are made by Arrow's compute functions inside the tasks that read the texts; what leaves
a task are partial counts.  The merged counts are dealt out by term, and each such shard holds
its part of the sums over all terms.  All arithmetic is on integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moodspark.llm.common import stage, table

#: What stands between terms: every ASCII character but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Exact shares need 1000 * (all terms of a language) in 64 bits.
MOST_TERMS = (2**63 - 1) // 1000

TEXT_BYTES = 8 << 20  # of texts that are split at once
HELD_ROWS = 400_000  # partial counts that a task holds before they are merged
SHARD_ROWS = 20_000
BLOCK = 256  # sources that are compared with as many others at once
SLICE = 2_048  # terms in a matrix

COUNTS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]
)
NAMES = ["lang", "source", "term"]


def _merged(parts: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(parts).group_by(NAMES).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.rename_columns(["lang", "source", "term", "n", "docs"]).cast(COUNTS)


def _counts(texts: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Table:
    """Occurrences and documents of each term by language and source; the term '' counts documents."""
    terms = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    doc = pc.list_parent_indices(terms)
    encoded = pc.dictionary_encode(pc.list_flatten(terms))
    each = pa.table({"doc": doc, "code": encoded.indices}).group_by(["doc", "code"]).aggregate([([], "count_all")])
    langs, sources = pc.dictionary_encode(lang), pc.dictionary_encode(source)
    group = pc.add(
        pc.multiply(langs.indices.cast(pa.int64()), len(sources.dictionary)), sources.indices.cast(pa.int64())
    )
    each = pa.table({"group": group.take(each["doc"]), "code": each["code"], "n": each["count_all"]})
    summed = each.group_by(["group", "code"]).aggregate([("n", "sum"), ("n", "count")])
    term = encoded.dictionary.take(summed["code"].combine_chunks())
    # pieces before the first and after the last term are empty
    summed = summed.append_column("term", term).filter(pc.not_equal(term, ""))
    present = pa.table({"group": group}).group_by("group").aggregate([([], "count_all")])
    group = pa.chunked_array([*summed["group"].chunks, *present["group"].chunks], pa.int64()).combine_chunks()
    zeros = pa.array(np.zeros(len(present), np.int64))
    return pa.table(
        [
            langs.dictionary.take(pc.divide(group, len(sources.dictionary))),
            sources.dictionary.take(pc.subtract(group, pc.multiply(
                pc.divide(group, len(sources.dictionary)), len(sources.dictionary)))),
            pa.chunked_array([*summed["term"].chunks, pa.array([""] * len(present), pa.string())], pa.string()),
            pa.chunked_array([*summed["n_sum"].chunks, zeros], pa.int64()),
            pa.chunked_array([*summed["n_count"].chunks, *present["count_all"].chunks], pa.int64()),
        ],
        schema=COUNTS,
    )


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about TEXT_BYTES of text, a row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        past = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, past + TEXT_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents (text, lang, source), merged whenever many are held.

    What is still large after merging goes out, so a task's memory has a bound; Spark adds up.
    """
    held: list[pa.Table] = []
    for batch in batches:
        for part in _slices(batch):
            held.append(_counts(part.column(0), part.column(1), part.column(2)))
            if sum(map(len, held)) > HELD_ROWS:
                held = [_merged(held)]
                if len(held[0]) > HELD_ROWS // 2:
                    yield from held.pop().to_batches()
    if held:
        yield from _merged(held).to_batches()


def term_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with the term).

    A row with the term '' counts the documents of every group, those without terms too.  Null
    text, lang and source count as ''.  Each row is a document, repeated rows as well.  Extra
    columns are not read.  An empty table gives no rows.
    """
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    partial = read.mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    return partial.groupBy(*NAMES).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / whole) for count <= whole, in three steps of long division."""
    rest, quotient = count, np.zeros_like(count)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + step
    return quotient + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


PARTIAL = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]
)


def _shard(top: int):
    """Function over one shard's terms and all groups of two blocks of sources.

    Gives the shard's part of each pair's sum, for pairs of a source of the first block with one
    of the second, and each source's `top` terms of the shard.  Terms are taken in slices, so that
    a matrix of sources and terms has a fixed size.
    """

    def compare(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        a, b = key[1].as_py(), key[2].as_py()
        out: list[pa.Table] = []
        for lang in pc.unique(groups["lang"]).to_pylist():
            mine = groups.filter(pc.equal(groups["lang"], lang))
            here = counts.filter(pc.equal(counts["lang"], lang))
            names, block = mine["source"].combine_chunks(), mine["block"].to_numpy()
            n, v, all_n = (mine[c].to_numpy().astype(np.int64) for c in ("n", "v", "lang_n"))
            whole, lang_whole = n + 2 * v, all_n[0] + 2 * v[0]
            first, second = np.flatnonzero(block == a), np.flatnonzero(block == b)
            sums = np.zeros((len(first), len(second)), np.int64)
            encoded = pc.dictionary_encode(here["term"].combine_chunks())
            code = encoded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            code, row = code[order], pc.index_in(here["source"].combine_chunks(), names).to_numpy()[order]
            count, lang_count = here["n"].to_numpy()[order], here["term_n"].to_numpy()[order]
            for start in range(0, len(encoded.dictionary), SLICE):
                width = min(SLICE, len(encoded.dictionary) - start)
                lo, hi = np.searchsorted(code, (start, start + width))
                held = np.zeros((len(names), width), np.int64)
                held[row[lo:hi], code[lo:hi] - start] = count[lo:hi]
                p = share(held + 2, whole[:, None])
                for i, left in enumerate(first):
                    others = second[i + 1 :] if a == b else second
                    if len(others):
                        sums[i, len(second) - len(others) :] += _distance(p[left], p[others]).sum(axis=1)
                if a == b:
                    total = np.zeros(width, np.int64)
                    total[code[lo:hi] - start] = lang_count[lo:hi]
                    q = share(total + 2, np.full(width, lang_whole))
                    far = (held > 0) & (p > q)
                    source, term = np.nonzero(far)
                    value = _distance(p[source, term], q[term])
                    out.append(_top(lang, names.take(pa.array(source)), encoded.dictionary.take(pa.array(term + start)), value, top))
            # terms of the shard that no source of these blocks has
            least = share(np.full(len(n), 2), np.maximum(whole, 2))
            left, right = least[first][:, None], least[second][None, :]
            sums += (mine["terms"].to_numpy()[0] - len(encoded.dictionary)) * _distance(left, right)
            if mine["terms"].to_numpy()[0] or key[0].as_py() == 0:
                i, j = np.triu_indices(len(first), 1) if a == b else np.indices(sums.shape).reshape(2, -1)
                left, right = pa.array(first[i]), pa.array(second[j])
                out.append(_rows(lang, names.take(left), "pair", names.take(right), sums[i, j]))
        return pa.concat_tables(out).combine_chunks() if out else PARTIAL.empty_table()

    return compare


def _rows(lang: str, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.Table:
    n = len(value)
    return pa.table([pa.array([lang] * n, pa.string()), source, pa.array([part] * n, pa.string()), item, pa.array(value)], schema=PARTIAL)


def _top(lang: str, source: pa.Array, item: pa.Array, value: np.ndarray, top: int) -> pa.Table:
    """The first `top` rows of each source, largest value first, then by item."""
    rows = _rows(lang, source, "term", item, value)
    rows = rows.sort_by([("source", "ascending"), ("value", "descending"), ("item", "ascending")])
    code = pc.dictionary_encode(rows["source"].combine_chunks()).indices.to_numpy()
    place = np.arange(len(code)) - np.searchsorted(code, code)
    return rows.filter(pa.array(place < top))


def divergences(counts: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """Divergence of every source from each other source of its language, and its own terms.

    `counts` is as term_counts gives it.  A language keeps the V terms that min_docs of its
    documents hold.  A group's share of a term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N
    its count of all kept terms; the language's share is made the same way.  Between two shares
    lies f = floor((p - q)^2 / (p + q)).

    Rows: lang, source, part, item, value, rank.  Part 'pair' has each other source of the
    language with the sum of f over all kept terms, 0 where none is kept; part 'term' the `top`
    terms that the source uses more than its language does, by f.  Ranks are from 1, value
    descending, item ascending by UTF-8.

    A shard is a part of the terms of all languages, whose rows have a bound; sources are compared
    in blocks, so one shard's matrices have one as well.  What a shard gives is no more than what
    it gets, whatever the number of sources.  Each group, even of a third of all rows, is one row a term here.
    """
    of_term = Window.partitionBy("lang", "term")
    kept = (
        counts.where("term <> ''")
        .withColumn("df", F.sum("docs").over(of_term))
        .withColumn("term_n", F.sum("n").over(of_term))
        .withColumn("first", F.min("source").over(of_term) == F.col("source"))
        .where(F.col("df") >= min_docs)
        .select("lang", "source", "term", "n", "term_n", "first")
    )
    kept = stage(kept, "terms")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("lang_n"))
    groups = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    groups = stage(groups, "groups")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("lang_n").alias("lang_n"), F.max("v").alias("v"))
    most, pairs, terms = sizes.agg(
        F.coalesce(F.max("sources"), F.lit(0)),
        F.coalesce(F.sum(F.expr("sources * (sources - 1) div 2")), F.lit(0)),
        F.coalesce(F.max(F.expr("lang_n + 2 * v")), F.lit(0)),
    ).first()
    if terms > MOST_TERMS:
        raise ValueError("a language has more terms than exact 64-bit shares allow")
    blocks = max(1, math.ceil(most / BLOCK))
    shards = max(1, math.ceil(kept.count() * blocks / max(SHARD_ROWS, min(pairs, 10 * SHARD_ROWS))))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    # a source's block meets every block; the smaller number comes first
    both = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, "block").alias("a"), F.greatest(o, "block").alias("b"))))
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")
    dealt = kept.withColumn("shard", shard)
    rows = dealt.withColumn("block", block).withColumn("ab", both).select("shard", "ab.a", "ab.b", "lang", "source", "term", "n", "term_n")
    all_groups = (
        groups.withColumn("block", block)
        .withColumn("ab", both)
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .join(dealt.where("first").groupBy("shard", "lang").agg(F.count("*").alias("terms")), ["shard", "lang"], "left")
        .select("shard", "ab.a", "ab.b", "lang", "source", "block", "n", "v", "lang_n", F.coalesce("terms", F.lit(0)).alias("terms"))
    )
    found = (
        rows.groupBy("shard", "a", "b")
        .cogroup(all_groups.groupBy("shard", "a", "b"))
        .applyInArrow(_shard(top), "lang string, source string, part string, item string, value long")
    )
    found = stage(found, "divergences")
    by = [F.col("value").desc(), F.col("item").asc()]
    half = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    half = half.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s"), "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by)).alias("rank")
    pairs = half.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    pairs = pairs.select("*", ranked)
    own_terms = found.where("part = 'term'").select("*", ranked).where(F.col("rank") <= top)
    return pairs.unionByName(own_terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "lang", "source")
    return divergences(stage(term_counts(docs), "counts"))


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), groups AS (SELECT DISTINCT lang, source FROM words
), counts AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs
  FROM (SELECT doc, lang, source, unnest(terms) AS term FROM words) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, term HAVING sum(docs) >= 10
), langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), held AS (
  SELECT c.lang, c.source, c.term, c.n FROM counts c JOIN kept k ON c.lang = k.lang AND c.term = k.term
), totals AS (SELECT lang, source, sum(n) AS n FROM held GROUP BY lang, source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(h.n, 0) + 2) // (coalesce(t.n, 0) + 2 * l.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
