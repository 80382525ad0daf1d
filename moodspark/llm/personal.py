"""Personal data: base patterns, and boosted trees over spans that freer patterns propose."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm.common import stage, table

KINDS = ("email", "ip", "card", "phone")
#: Documents whose base spans teach the trees, at most, in the order of a hash of doc_id.
SAMPLE_ROWS = 20_000
#: Base spans of the sample that are taken, at most.
SAMPLE_SPANS = 4_000
#: Characters on either side that count as a span's context.
CONTEXT = 30

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the second alternative eats runs of digits that begin no address, so that none is tried twice
_IP = re.compile(r"([0-9]+(?:\.[0-9]+){3})|[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Left-to-right matches: the letters before each @ back to the match before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns that pass their checks, by start and then by kind."""
    found = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if m[1] and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:3] or 0) <= 255 for x in m[1].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = digits_of(m[0]) if len(m[0]) <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Generators of high recall.  Their spans overlap; the trees choose.
_AT = re.compile(r" ?[\[({] ?(?:at|AT|@) ?[\])}] ?")
_HIDDEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?: ?(?:[\[({] ?(?:dot|DOT|\.) ?[\])}]|\.) ?[A-Za-z0-9-]+)+")
_HIDDEN_IP = re.compile(
    r"(?<![0-9.])[0-9]{1,3}(?: ?(?:[\[({] ?(?:\.|dot) ?[\])}]|\.) ?[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
)
_RUN = re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/ ]{0,3}[0-9])+")
_GROUP = re.compile(r"[+(]*[0-9]+\)?")


def _hidden_emails(text: str) -> Iterator[Span]:
    """Letters in front of each marked "at", back to the one before it, and the domain behind it."""
    free = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _HIDDEN_DOMAIN.match(text, m.end()) if start < m.start() else None
        if found:
            yield "email", start, found.end()
        free = m.end()


def candidates(text: str) -> list[Span]:
    found = list(_hidden_emails(text))
    found += [("ip", *m.span()) for m in _HIDDEN_IP.finditer(text)]
    for run in _RUN.finditer(text):
        groups = [(run.start() + g.start(), run.start() + g.end()) for g in _GROUP.finditer(run[0])]
        sizes = [len(digits_of(text[a:b])) for a, b in groups]
        for k in range(len(groups)):  # every window of groups with 19 digits at most
            total = 0
            for j in range(k, len(groups)):
                total += sizes[j]
                if total > 19:
                    break
                if 12 <= total:
                    found.append(("card", groups[k][0], groups[j][1]))
                if 9 <= total <= 15 and j > k:
                    found.append(("phone", groups[k][0], groups[j][1]))
    return found


def features(text: str, span: Span) -> list[float]:
    """Numbers that describe the span's format and its context."""
    kind, start, end = span
    inside = text[start:end]
    digits = digits_of(inside)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = [len(x) for x in re.findall("[0-9]+", inside)] or [0]
    marks = [c for c in inside if not c.isalnum()]
    return [
        KINDS.index(kind),
        len(inside),
        len(digits),
        len(groups),
        max(groups),
        groups[-1],
        len(marks),
        len(set(marks)),
        inside.startswith("+"),
        "(" in inside and ")" in inside,
        12 <= len(digits) <= 19 and luhn(digits),
        max((int(x[-4:]) for x in re.findall("[0-9]+", inside)), default=0) <= 255,
        inside[-2:].isalpha(),
        before[-1:].isalnum() + after[:1].isalnum(),
        before[-1:] in "+-./,=#" and before != "",
        sum(map(str.isdigit, before)) + sum(map(str.isdigit, after)),
        bool(re.search(r"(?i)tel|phone|call|fax|mobil|card|visa|mail|contact|\bip\b|host|addr", before)),
    ]


@dataclass
class Trees:
    """Boosted regression trees of depth 3: per tree the features and limits of 7 nodes, 8 leaves."""

    rate: float = 0.3
    start: float = 0.0
    trees: list[tuple[list[int], list[float], list[float]]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for which, limits, leaves in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(3):
                at = 2 * at + 1 + (x[np.arange(len(x)), np.array(which)[at]] > np.array(limits)[at])
            total += self.rate * np.array(leaves)[at - 7]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 30) -> Trees:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(share / (1 - share)))
        for _ in range(rounds):
            p = self.predict(x)
            slope, bend = y - p, p * (1 - p)
            which, limits, leaves = [0] * 7, [np.inf] * 7, [0.0] * 8
            rows = {0: np.arange(len(y))}
            for node in range(15):
                here = rows.get(node, np.empty(0, int))
                if node >= 7:
                    leaves[node - 7] = float(slope[here].sum() / (bend[here].sum() + 1.0))
                    continue
                which[node], limits[node] = self._split(x[here], slope[here], bend[here])
                right = x[here, which[node]] > limits[node]
                rows[2 * node + 1], rows[2 * node + 2] = here[~right], here[right]
            self.trees.append((which, limits, leaves))
        return self

    @staticmethod
    def _split(x: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> tuple[int, float]:
        best, found = 1e-9, (0, np.inf)
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            for limit in (values[:-1] + values[1:])[:: max(1, len(values) // 16)] / 2:
                right = x[:, k] > limit
                g, h = slope[right].sum(), bend[right].sum()
                all_g, all_h = slope.sum(), bend.sum()
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                if gain > best:
                    best, found = gain, (k, float(limit))
        return found


@dataclass
class Finder:
    """A fitted model and, by kind, the score from which a candidate is redacted."""

    trees: Trees = field(default_factory=Trees)
    limits: dict[str, float] = field(default_factory=lambda: dict.fromkeys(KINDS, 2.0))

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """The base spans, and all: base ones stay, others that overlap none join by score."""
        if not re.search("[0-9@]", text) and not re.search(r"[\[({] ?(?:at|AT)", text):
            return [], []
        base = base_spans(text)
        # candidates that overlap a base span say nothing new
        taken = Taken(base)
        proposed = [c for c in set(candidates(text)) if not taken.overlaps(c)]
        chosen = list(base)
        if proposed and self.trees.trees:
            scores = self.trees.predict(np.array([features(text, c) for c in proposed], float))
            order = sorted(zip(scores, proposed, strict=True), key=lambda x: (-x[0], -(x[1][2] - x[1][1]), x[1]))
            for p, c in order:
                if p >= self.limits[c[0]] and not taken.overlaps(c):
                    chosen.append(c)
                    taken.add(c)
        return base, sorted(chosen, key=lambda s: (s[1], KINDS.index(s[0])))


class Taken:
    """Places of a text that spans have taken, as intervals apart from one another, in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):  # base spans of two kinds may overlap
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, span: Span) -> bool:
        k = bisect_left(self.starts, span[2]) - 1
        return k >= 0 and self.ends[k] > span[1]

    def add(self, span: Span) -> None:
        """A span that overlaps none."""
        k = bisect_left(self.starts, span[1])
        self.starts.insert(k, span[1])
        self.ends.insert(k, span[2])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (kind, text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT])
            for text in batch.column(0).to_pylist()
            for kind, a, b in base_spans(text or "")
        ]
        yield pa.record_batch(
            [pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["kind", "before", "span", "after"]
        )


def examples(spans: list[tuple[str, str, str, str]], seed: int = 7) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and kinds of spans to learn from.

    Base spans and the same personal data in other dress are the positives.  In the same contexts,
    numbers of other kinds and spans with digits lost or added are the negatives.
    """
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    x, y, kinds = [], [], []

    def add(kind: str, before: str, inside: str, after: str, label: int) -> None:
        x.append(features(before + inside + after, (kind, len(before), len(before) + len(inside))))
        y.append(label)
        kinds.append(kind)

    for kind, before, inside, after in spans:
        add(kind, before, inside, after, 1)
        digits = digits_of(inside)
        if kind == "email":
            local, _, domain = inside.partition("@")
            add(kind, before, f"{local} [at] {domain.replace('.', ' [dot] ')}", after, 1)
            add(kind, before, f"{local}(at){domain}", after, 1)
            letters = re.sub("[0-9]", "", local).strip(".") or "a"
            add(kind, before, f"{letters} [at] {re.sub('[0-9]', '', domain).replace('.', ' [dot] ')}", after, 1)
            add(kind, before, f"{local[:1]} (at) {number(1)}.{number(1)}", after, 0)
        elif kind == "ip":
            add(kind, before, inside.replace(".", "[.]"), after, 1)
            add(kind, before, ".".join(str(rng.randint(256, 999)) for _ in range(4)), after, 0)
            add(kind, before + "v", ".".join(str(rng.randint(0, 20)) for _ in range(4)), after, 0)
        elif kind == "card":
            add(kind, before, ".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), after, 1)
            wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
            add(kind, before, wrong, after, 0)
            add(kind, before, "/".join([wrong[:4], wrong[4:8], wrong[8:]]), after, 0)
            add(kind, before + number(6), digits, number(5) + after, 0)
        else:
            add(kind, before, f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", after, 1)
            add(kind, before, f"00{digits[:-7]} {digits[-7:-4]} {digits[-4:]}", after, 1)
            add(kind, before, inside, f" {number(16)} {after}", 1)
            add(kind, before, f"{number(4)}-{number(2)}-{number(2)} {number(2)}", after, 0)
            add(kind, before, f"{number(3)}.{number(3)}.{number(3)}", after, 0)
            add(kind, before, f"{number(6)} {number(5)}", after, 0)
            add(kind, before + number(4) + "-", f"{number(5)}-{number(6)}", "-" + number(4) + after, 0)
            add(kind, before, f"{inside} {number(4)}", number(12) + after, 0)
    return np.array(x, float), np.array(y, float), kinds


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, spans: int = SAMPLE_SPANS) -> Finder:
    """Trees from the base spans of a bounded sample; limits that keep 99 of 100 redactions right.

    A third of the examples is held back for the limits.  A kind whose limit cannot be met, or of
    which the sample has no span, gets no spans beyond the base.
    """
    sample = docs.where("text IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(rows)
    ids = stage(sample.where("doc_id IS NOT NULL").distinct(), "sample-ids")
    texts = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text")  # bounded by `rows`
    found = texts.mapInArrow(_contexts, "kind string, before string, span string, after string").distinct()
    rank = F.xxhash64("kind", "before", "span", "after")
    taken = [tuple(r) for r in found.orderBy(rank, "span", "before").limit(spans).collect()]
    x, y, kinds = examples(taken)
    if not len(y) or y.min() == y.max():
        return Finder()
    held = np.arange(len(y)) % 3 == 0
    trees = Trees().fit(x[~held], y[~held])
    scores, limits = trees.predict(x[held]), {}
    for kind in KINDS:
        own = np.array([k == kind for k in kinds])[held]
        p, truth = scores[own], y[held][own]
        good = [t for t in np.unique(p) if t >= 0.5 and truth[p >= t].mean() >= 0.99]
        limits[kind] = float(min(good)) if good else 2.0
    return Finder(trees, limits)


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, redacted string"


def find(docs: DataFrame, model: Finder, redacted: bool = True) -> DataFrame:
    """doc_id, base spans by kind, base and all spans as kind:start:end, and the redacted text.

    Offsets are code points, ends exclusive.  In the redacted text every span, or run of spans that
    overlap, is its first kind in angle brackets.  Null text is empty.  Each row is judged by itself;
    rows without doc_id and repeated rows are too.  Extra columns are not read.  An empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [model.spans(t) for t in texts]
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                yield pa.record_batch(
                    [
                        part.column(0),
                        *counts,
                        pa.array([written(base) for base, _ in found], pa.string()),
                        pa.array([written(every) for _, every in found], pa.string()),
                        pa.array(
                            [_redact(t, every) for t, (_, every) in zip(texts, found, strict=True)]
                            if redacted
                            else [None] * len(texts),
                            pa.string(),
                        ),
                    ],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "redacted"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, FOUND)


def _redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs), redacted=False).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"
    )
