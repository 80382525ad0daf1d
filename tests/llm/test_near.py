"""Near-duplicate operators against brute force on small fixtures."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

import moodspark.llm.components as module
from moodspark.llm import hnsw, minhash
from moodspark.llm.common import stage as written
from moodspark.llm.components import components

WORDS = [f"w{k}" for k in range(400)]


def union(pairs, nodes):
    at = {n: n for n in nodes}

    def root(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def near_texts():
    rng = random.Random(3)
    texts = {}
    for group in range(6):
        base = [rng.choice(WORDS) for _ in range(60)]
        for copy in range(25 if group == 0 else 4):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts[len(texts) * 3] = " ".join(words)
    texts |= {1: None, 2: "", 4: " \t ", 5: "one", 7: "ONE", 8: "one two", 10: "É a", 11: "é a"}
    texts[901] = texts[0].upper()
    texts[902] = "same word " * 5_000
    texts[904] = "same word " * 5_001
    return texts


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_is_brute_force(spark, width):
    texts = near_texts()
    sets = {i: shingle_set(t, width) for i, t in texts.items()}
    pairs = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    found = union(pairs, sets)
    df = spark.createDataFrame(
        [(t, i, "x", True) for i, t in texts.items()], "text string, doc_id long, component_id string, kept boolean"
    )
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width).collect()}
    assert got == {i: (len(sets[i]), found[i], found[i] == i) for i in texts}


def test_minhash_without_ids_rows_and_with_repeats(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "k l m n o p"), (2, "k l m n o p"), (3, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(
        [(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)], key=str
    )
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 40)]
    pairs += [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(70)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    true = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == union(true, {n for p in true for n in p})


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """A last round that changed nothing took six shuffles; on many small partitions that is thousands of tasks."""
    rounds = []
    monkeypatch.setattr(module, "stage", lambda df, name: (rounds.append(name), written(df, name))[1])
    edges = [(k, k % 3) for k in range(3, 60)] + [(k % 3, k) for k in range(3, 60)] + [(None, 1), (5, 5), (100, 100)]
    got = {(r.node, r.component) for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, k % 3) for k in range(60)} and len(rounds) == 1
    rounds.clear()
    edges += [(2, 1), (200, 201), (201, 202)]
    got = {(r.node, r.component) for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, min(k % 3, 1)) for k in range(60)} | {(k, 200) for k in (200, 201, 202)}
    assert 2 <= len(rounds) <= 3


def test_vectors_are_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(260, 8))
    x[100:180] = x[0] + 0.1 * rng.normal(size=(80, 8))
    x[180:190] = x[1]
    rows = [(int(k) + 10, v.tolist(), 0) for k, v in enumerate(x.astype(np.float32))]
    rows += [(1, None, 0), (2, [0.0] * 8, 0), (3, [1.0, None] + [0.0] * 6, 0), (4, [float("nan")] * 8, 0), (5, [], 0)]
    rows += [(6, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    y = np.array([r[1] for r in rows[:260]], np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = y @ y.T >= 0.95
    np.fill_diagonal(linked, False)
    found = union([(a + 10, b + 10) for a, b in zip(*np.nonzero(linked), strict=True)], [r[0] for r in rows[:-1]])
    want = {i: (int(linked[i - 10].sum()) if 10 <= i < 270 else 0, c, c == i) for i, c in found.items()}
    want[None] = (0, None, True)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(df).collect()}
    assert got == want


def test_graph_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 1500)] + 0.25 * rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    who, node, recall, _ = hnsw.Graph(x).audited(x, 0.9)
    truth = int(np.count_nonzero(x @ x.T >= 0.9))
    assert recall >= 0.999 and 0.99 * truth <= len(who) <= truth
    assert len({*zip(who.tolist(), node.tolist(), strict=True)}) == len(who)


def unit_rows(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(x, least=0.95):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = y @ y.T >= least
    np.fill_diagonal(linked, False)
    found = union(zip(*(a.tolist() for a in np.nonzero(linked)), strict=True), range(len(x)))
    return {i: (int(linked[i].sum()), found[i], found[i] == i) for i in range(len(x))}


def grouped_vectors():
    """A large group around one vector, a chain, small groups, equal vectors and single ones."""
    rng = np.random.default_rng(8)
    x = unit_rows(rng, 900, 24)
    x[100:420] = x[0] + 0.045 * rng.normal(size=(320, 24))
    a, b = unit_rows(rng, 2, 24)
    turn = np.arange(60)[:, None] * 0.25
    x[420:480] = np.cos(turn) * a + np.sin(turn) * (b - (a @ b) * a) / np.sqrt(1 - (a @ b) ** 2)
    x[480:520] = x[520:560] + 0.02 * rng.normal(size=(40, 24))
    x[560:600] = x[5]
    return x[rng.permutation(900)].astype(np.float32)


@pytest.mark.parametrize("sizes", [{}, {"whole_rows": 16, "shard_rows": 70, "block_rows": 50}])
@pytest.mark.parametrize("cells", [False, True])
def test_neighbourhoods_are_brute_force(spark, monkeypatch, sizes, cells):
    """Cells and graphs are for many vectors; here they are made for few."""
    if cells:
        monkeypatch.setattr(hnsw, "ONE_CELL", 100)
        monkeypatch.setattr(hnsw, "CELL_ROWS", 100)
        assert hnsw._dealing(24, 900, 0.95)[0]
    staged = []
    monkeypatch.setattr(hnsw, "stage", lambda df, name: (staged.append(df.schema), written(df, name))[1])
    x = grouped_vectors()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(df, **sizes).collect()}
    assert got == brute(x.astype(float))
    # graphs were written as one cell each, and copied for each block of queries
    assert not any(isinstance(f.dataType, T.BinaryType) for schema in staged for f in schema)


def test_vectors_of_no_neighbour_and_none(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(np.eye(6).tolist())], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, hnsw.near_vectors(df).collect())) == [(k, 0, k, True) for k in range(6)]
    assert hnsw.near_vectors(df.limit(0)).count() == 0


def test_links_of_a_tight_group_take_little_memory():
    """All pairs of a walk's front were held at once, with 24 neighbours each."""
    rng = np.random.default_rng(6)
    x = 0.02 * rng.normal(size=(1200, 32)) + unit_rows(rng, 1, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    tracemalloc.start()
    who, node = graph.within(x[:256], 0.95, 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(who) == np.count_nonzero(x[:256] @ x.T >= 0.95) and peak < 64 << 20


def test_vectors_at_the_limit_share_a_cell():
    rng = np.random.default_rng(7)
    count, dealings = hnsw._dealing(32, 1_000_000, 0.95)
    a = unit_rows(rng, 3000, 32)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    cells = []
    for x in (a, b):
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 32), pa.int32()), pa.array(x.ravel()))
        batch = pa.record_batch({"id": pa.array(np.arange(len(x))), "v": flat})
        out = pa.Table.from_batches(hnsw._deal({32: (0, count, dealings)})([batch]))
        cells.append(out["cell"].to_numpy().reshape(len(x), -1))
    shared = (cells[0][:, :, None] == cells[1][:, None, :]).any((1, 2))
    assert shared.mean() >= 0.998
    assert len(np.unique(cells[0])) > 300


@pytest.mark.parametrize(("led", "kept"), [(16_384, 1 << 27), (150, 1 << 27), (150, 1 << 10)])
def test_rows_of_a_cell_that_link_meet(monkeypatch, led, kept):
    monkeypatch.setattr(hnsw, "LED_FROM", led)
    monkeypatch.setattr(hnsw, "KEPT_BYTES", kept)
    monkeypatch.setattr(hnsw, "BLOCK", 64)
    x = grouped_vectors().astype(float)
    cell = hnsw._Cell(0.95)
    cell.add(np.arange(len(x)), np.rint(127 * x / np.abs(x).max(axis=1, keepdims=True)).astype(np.int8))
    ids, other = cell.edges()
    met = union(zip(ids.tolist(), other.tolist(), strict=True), range(len(x)))
    assert all(met[i] == met[c] for i, (_, c, _) in brute(x).items())
    if kept > 1 << 10:
        assert len(set(met.values())) > 300


@pytest.mark.parametrize("spread", [0.01, 0.055])
def test_shards_are_walked_or_compared_whole(spread):
    """Tight groups are compared with all nodes, loose ones by their graph."""
    rng = np.random.default_rng(9)
    x = np.repeat(unit_rows(rng, 100, 24), 12, axis=0)
    x = (x[:1] if spread < 0.05 else x) + spread * rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(len(x))
    shard = hnsw._Shard(ids, x, np.full(len(x), 2), 0.95)
    shard.ask(ids[:700], x[:700])
    shard.ask(ids[700:], x[700:])
    assert (shard.graph is None) == (spread < 0.05)
    told = pa.Table.from_batches(shard.told()).to_pylist()
    want = brute(x[np.argsort(ids)])
    assert {r["id"]: r["n"] for r in told if r["n"]} == {i: 2 * n for i, (n, _, _) in want.items() if n}
    met = union([(r["id"], r["other"]) for r in told], range(len(x)))
    assert met == {i: c for i, (_, c, _) in want.items()}


def test_what_a_walk_misses_is_found(monkeypatch):
    rng = np.random.default_rng(10)
    x = np.repeat(unit_rows(rng, 100, 24), 3, axis=0) + 0.03 * rng.normal(size=(300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(hnsw.Graph, "hits", lambda self, q, *_: iter([(0, np.zeros((len(q), len(self.x)), bool))]))
    shard = hnsw._Shard(np.arange(300), x, np.ones(300, np.int64), 0.95)
    shard.ask(np.arange(300), x)
    told = pa.Table.from_batches(shard.told()).to_pylist()
    assert {r["id"]: r["n"] for r in told if r["n"]} == {i: n for i, (n, _, _) in brute(x).items() if n}
