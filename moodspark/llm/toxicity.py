"""Toxicity: misspelled lexicon terms by automata over a trie, weighed by their context."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm.common import fold, releasing, table
from moodspark.llm.fit import SAMPLE_ROWS, labelled_sample, logistic, probability

WORD = re.compile(r"[^\W_]+")
#: Evidence, in nats over the share of toxic text, that a word must show to be a term.
EVIDENCE = 18.0
#: Words of at least this many letters may be one edit away, longer ones two.
ONE_EDIT, TWO_EDITS = 5, 12
WORDS_KEPT = 250_000
WINDOW = 12

# Marks that open and close a quotation, and words that report speech.
OPENING, CLOSING, STRAIGHT = "“„«‹", "”»›", '"'
_MARKS = re.compile(f"[\n{STRAIGHT}{OPENING}{CLOSING}]")
REPORTING = frozenset("said says wrote writes quoted called sagte schrieb zitierte dit écrit dijo escribió".split())


def edits_allowed(term: str) -> int:
    return 0 if len(term) < ONE_EDIT else 1 if len(term) < TWO_EDITS else 2


class Matcher:
    """Finds the lexicon term that a word spells, perhaps with a few wrong letters.

    A state is a set of (trie node, edits so far): the product of the lexicon's trie and the
    Levenshtein automaton.  States are made when first reached and kept with their transitions, so
    most words end after a few letters in the empty state.  Letters outside the lexicon's alphabet
    are all alike.
    """

    def __init__(self, terms: list[str], ordinary: frozenset[str] = frozenset()):
        self.ordinary = ordinary
        self.children: list[dict[str, int]] = [{}]
        self.term_at: dict[int, str] = {}
        self.most: list[int] = [0]  # edits that some term below a node allows
        for term in terms:
            node, allowed = 0, edits_allowed(term)
            self.most[0] = max(self.most[0], allowed)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], allowed)
            self.term_at[node] = term
        self.alphabet = {x for t in terms for x in t}
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})
        self.memo: dict[str, tuple[str, int] | None] = {}

    def _state(self, least: dict[int, int]) -> int:
        """Number of a state given the fewest edits of each node; adds left-out letters."""
        queue = list(least)
        while queue:
            node = queue.pop()
            for child in self.children[node].values():
                e = least[node] + 1
                if e <= self.most[child] and e < least.get(child, 99):
                    least[child] = e
                    queue.append(child)
        key = frozenset(least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [
                (e, self.term_at[n]) for n, e in key if n in self.term_at and e <= edits_allowed(self.term_at[n])
            ]
            self.found.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        least: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.most[node] and e < least.get(node, 99):
                least[node] = e

        for node, e in self.sets[state]:
            reach(node, e + 1)  # a letter too many
            for x, child in self.children[node].items():
                reach(child, e + (x != letter))
        return self._state(least)

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits), the fewest edits first; None for ordinary words."""
        state = self.start
        for letter in word:
            if letter not in self.alphabet:
                letter = ""
            after = self.steps[state].get(letter)
            if after is None:
                after = self.steps[state][letter] = self._step(state, letter)
            state = after
            if state == self.dead:
                return None
        found = self.found[state]
        return None if found and found[1] and word in self.ordinary else found

    def __call__(self, word: str) -> tuple[str, int] | None:
        try:
            return self.memo[word]
        except KeyError:
            if len(self.memo) >= WORDS_KEPT:
                self.memo.clear()
            self.memo[word] = found = self.match(word)
            return found


@dataclass
class Toxicity:
    """A fitted model: terms, words that only look like terms, weights of the score."""

    terms: list[str]
    ordinary: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])


class Quotations:
    """Where the text has quotation marks and line ends, read once."""

    def __init__(self, text: str):
        self.lines, self.opening, self.closing, self.straight = [], [], [], []
        for m in _MARKS.finditer(text):
            mark = m[0]
            kind = (
                self.lines if mark == "\n" else self.straight if mark == STRAIGHT
                else self.opening if mark in OPENING else self.closing
            )
            kind.append(m.start())
        self.end = len(text)

    def around(self, start: int, end: int, before: list[str]) -> bool:
        """The term stands between quotation marks of its line, or after a word that reports speech."""
        k = bisect_left(self.lines, start)
        low = self.lines[k - 1] if k else -1
        k = bisect_left(self.lines, end)
        high = self.lines[k] if k < len(self.lines) else self.end

        def last(places: list[int]) -> int:
            k = bisect_left(places, start)
            return places[k - 1] if k and places[k - 1] > low else -1

        def follows(places: list[int]) -> bool:
            k = bisect_left(places, end)
            return k < len(places) and places[k] < high

        if last(self.opening) > last(self.closing) and follows(self.closing):
            return True
        left = bisect_left(self.straight, start) - bisect_left(self.straight, low + 1)
        if left % 2 and follows(self.straight):
            return True
        return any(x in REPORTING for x in before)


def hits(text: str, find: Matcher) -> list[tuple[str, str, float]]:
    """(word, term, score) of each term in the text.

    A term as it is scores 1, a misspelled one 0.7 for each edit; in a quotation, a quarter of that;
    a second term within the window of words around it adds a quarter.
    """
    lower = text.lower()
    words = WORD.findall(lower)
    found = [(k, m) for k, m in enumerate(map(find, words)) if m]
    if not found:
        return []
    places = [m.span() for m in WORD.finditer(lower)]
    original = text if len(lower) == len(text) else lower
    out, at, marks = [], [k for k, _ in found], Quotations(original)
    for n, (k, (term, edits)) in enumerate(found):
        score = 0.7**edits
        if marks.around(*places[k], words[max(0, k - WINDOW // 2) : k]):
            score *= 0.25
        near = (n > 0 and k - at[n - 1] <= WINDOW) or (n + 1 < len(at) and at[n + 1] - k <= WINDOW)
        out.append((words[k], term, score * (1.25 if near else 1.0)))
    return out


def features(text: str, find: Matcher) -> tuple[float, float]:
    """Logarithms of the scores' sum and of their sum per thousand words."""
    total = sum(score for _, _, score in hits(text, find))
    if not total:
        return 0.0, 0.0
    return math.log1p(total), math.log1p(1000 * total / len(WORD.findall(text)))


def _rows(batches: Iterator[pa.RecordBatch], size: int = 256):
    """Lists of the batches' columns, a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield [c.to_pylist() for c in batch.slice(at, size).columns]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the number of clean and of toxic texts, those of toxic texts with their neighbours.

    Copies of a toxic text have the same neighbours everywhere, so a word that only copies share
    has few of them.
    """
    for labels, texts in _rows(batches):
        clean: Counter = Counter()
        toxic: Counter = Counter()
        uses: set = set()
        for label, text in zip(labels, texts, strict=True):
            words = WORD.findall(text.lower())
            if label:
                around = ["", *words, ""]
                toxic.update(set(words))
                uses.update((w, f"{around[k]} {around[k + 2]}") for k, w in enumerate(words))
            else:
                clean.update(set(words))
        rows = [(w, None, n, 0) for w, n in clean.items()] + [(w, None, 0, n) for w, n in toxic.items()]
        rows += [(w, around, 0, 0) for w, around in uses]
        yield pa.record_batch(
            [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
            ],
            names=["word", "around", "clean", "toxic"],
        )


def find_terms(sample: DataFrame) -> list[str]:
    """Words whose presence in toxic texts is beyond chance: the log-likelihood ratio of the
    number of texts, or of distinct uses if those are fewer, against the share of toxic texts among
    all is at least EVIDENCE."""
    sizes = sample.agg(F.sum("label").alias("t"), F.count("*").alias("n")).first()
    toxic, rows = sizes["t"] or 0, sizes["n"]
    if not toxic or toxic == rows:
        return []
    base = toxic / rows
    counted = (
        sample.select("label", "text")
        .mapInArrow(releasing(_word_counts), "word string, around string, clean long, toxic long")
        .groupBy("word")
        .agg(F.least(F.countDistinct("around"), F.sum("toxic")).alias("t"), F.sum("clean").alias("c"))
    )
    t, c = F.col("t"), F.col("c")
    share = t / (t + c)
    evidence = t * F.log(share / base) + F.when(c > 0, c * F.log((1 - share) / (1 - base))).otherwise(0)
    found = (
        counted.where((t >= 3) & (share > base) & (F.length("word") >= 3))
        .select("word", evidence.alias("e"), share.alias("share"))
        .where((F.col("e") >= EVIDENCE) & (F.col("share") >= max(0.5, min(0.9, 3 * base))))
    )
    # words of the sample, so their number has a bound
    return [r["word"] for r in sorted(found.collect(), key=lambda r: (-r["e"], r["word"]))]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS) -> Toxicity:
    """The model, from at most `rows` labelled rows outside the held-out fold.

    Terms come first.  Misspellings that occur in clean texts at least as often as in toxic ones
    are ordinary words.  A logistic regression then calibrates the texts' scores.
    """
    sample = labelled_sample(docs, labels, "toxic", folds, held_out, rows).select("label", "text")
    terms = find_terms(sample)
    if not terms:
        share = sample.agg(F.avg("label")).first()[0] or 0.0
        p = min(max(share, 1e-6), 0.49)
        return Toxicity([], weights=[0.0, 0.0, math.log(p / (1 - p))])

    def variants(batches):
        find = Matcher(terms)
        for found_labels, texts in _rows(batches):
            seen = [
                (word, label)
                for label, text in zip(found_labels, texts, strict=True)
                for word in {w for w, term, _ in hits(text, find) if w != term}
            ]
            yield pa.record_batch(
                [pa.array([r[0] for r in seen], pa.string()), pa.array([r[1] for r in seen], pa.int32())],
                names=["word", "label"],
            )

    # of the sample's words, so its size has a bound as well
    spelled = sample.mapInArrow(releasing(variants), "word string, label int").groupBy("word")
    clean = spelled.agg(F.sum(1 - F.col("label")).alias("c"), F.sum("label").alias("t")).where("c > 0 AND c >= t")
    ordinary = frozenset(r["word"] for r in clean.select("word").collect())

    def measure(batches):
        find = Matcher(terms, ordinary)
        for found_labels, texts in _rows(batches):
            x = [features(text, find) for text in texts]
            yield pa.record_batch(
                [
                    pa.array(found_labels, pa.int32()),
                    pa.array([a for a, _ in x], pa.float64()),
                    pa.array([b for _, b in x], pa.float64()),
                ],
                names=["label", "x", "y"],
            )

    # a few numbers for each row of the sample, in an order that does not depend on tasks
    measured = np.array(sorted(map(tuple, sample.mapInArrow(releasing(measure), "label int, x double, y double").collect())), float)
    return Toxicity(terms, ordinary, logistic(measured[:, 1:], measured[:, 0]).tolist())


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, score, predicted of every row's whole text; null text is empty.

    Only the text goes into the score.  Rows without doc_id are scored too.
    """
    terms, ordinary, weights = model.terms, model.ordinary, np.array(model.weights)

    def run(batches):
        find = Matcher(terms, ordinary)
        for ids, texts in _rows(batches):
            p = _probabilities(texts, find, weights)
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(p, pa.float64()),
                    pa.array((p >= 0.5).astype(np.int32), pa.int32()),
                ],
                names=["doc_id", "score", "predicted"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(releasing(run), "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Toxicity, limit: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, whose text scores under the limit."""
    terms, ordinary, weights = model.terms, model.ordinary, np.array(model.weights)
    at = docs.columns.index("text")

    def run(batches):
        find = Matcher(terms, ordinary)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keep = _probabilities(part.column(at).to_pylist(), find, weights) < limit
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)


def _probabilities(texts: list, find: Matcher, weights: np.ndarray) -> np.ndarray:
    return probability(np.array([features(text or "", find) for text in texts]).reshape(-1, 2), weights)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
