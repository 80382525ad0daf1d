"""Conversation structure repair: the cheapest edits that make turns alternate.

The edits are found as a lightest derivation.  An item (i, state) says that the first i rows have
been edited into a prefix of a well-formed conversation; a deduction joins it with an edit of
row i into an item (i + 1, state).  Items have a weight (cost, audit), audit being the initials
of the edits.  Deductions add to the cost and append to the audit, so a conclusion weighs no
less than its premise and keeps the order of premises: of two audits of equal cost over the same rows
neither is the beginning of the other, as what would be left of the longer one is inserts, which
cost.  The agenda therefore pops items in order of weight, and the first weight popped is final.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm.common import ASCII_SPACE, small_enough, stage, table

#: States: nothing yet, an opening system row, a user row that waits, a finished exchange.
EMPTY, OPENED, ASKED, ANSWERED = range(4)
AFTER = {EMPTY: {"s": OPENED, "u": ASKED}, OPENED: {"u": ASKED}, ASKED: {"a": ANSWERED}, ANSWERED: {"u": ASKED}}
#: The only state that a rerole or an insert leads to, and the role it writes.
NEXT = {EMPTY: ("user", ASKED), OPENED: ("user", ASKED), ASKED: ("assistant", ANSWERED), ANSWERED: ("user", ASKED)}
#: Inserts that finish a conversation in each state; the goal item follows from them.
CLOSING = {EMPTY: "", OPENED: "II", ASKED: "I", ANSWERED: ""}
GOAL = "goal"
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1

CHUNK = 256  # rows of a conversation that are held at once
BATCH = 5_000  # rows that go out together

Row = tuple  # role, text, must be deleted, cut short


def deductions(state: int, row: Row) -> Iterator[tuple[int, str, int]]:
    """(cost, letters, next state) of the edits that lead over a row.

    Inserts come right in front of a row that stays: in front of a deleted one they could as
    well come after it, with an audit that is less.  Two in a row lead back to where a row without
    them is kept at less cost, so one is enough.
    """
    role, _, bad, cut = row
    yield DELETE, "D", state
    if bad:
        return
    extra = CUT_SHORT if cut else 0
    for cost, letters, here in ((0, "", state), (INSERT, "I", NEXT[state][1])):
        if (kept := AFTER[here].get(role[:1])) is not None:
            yield cost + extra, letters + "K", kept
        yield cost + extra + REROLE, letters + "R", NEXT[here][1]


def derive(starts: dict[int, tuple], rows: list[Row], to_goal: bool) -> dict:
    """Final items after the rows: state -> (cost, rank of the start, audit, state of the start).

    `starts` holds the final items before the rows as state -> (cost, rank), ranks in order of
    their audits.  With `to_goal` only the goal item is wanted, and the agenda ends with it.
    """
    agenda = [(cost, rank, "", 0, state, state) for state, (cost, rank) in starts.items()]
    heapq.heapify(agenda)
    final, ends = set(), {}
    while agenda:
        cost, rank, audit, i, state, start = heapq.heappop(agenda)
        if i > len(rows):
            return {GOAL: (cost, rank, audit, start)}
        if (i, state) in final:
            continue
        final.add((i, state))
        if i < len(rows):
            for more, letters, after in deductions(state, rows[i]):
                if (i + 1, after) not in final:
                    heapq.heappush(agenda, (cost + more, rank, audit + letters, i + 1, after, start))
        elif to_goal:
            closing = CLOSING[state]
            heapq.heappush(agenda, (cost + INSERT * len(closing), rank, audit + closing, i + 1, state, start))
        else:
            ends[state] = (cost, rank, audit, start)
            if len(ends) == len(AFTER):
                break
    return ends


def apply(audit: str, state: int, rows: Iterator[Row]) -> Iterator[tuple]:
    """(letter, role, text, state before, row or None) of each edit."""
    for letter in audit:
        row = None if letter == "I" else next(rows)
        role, text = ("", "") if row is None else row[:2]
        before = state
        if letter in "IR":
            role, state = NEXT[state]
        elif letter == "K":
            state = AFTER[state][role[:1]]
        yield letter, role, text, before, row


def _hashed(digest, edits: Iterator[tuple]):
    digest = digest.copy()
    for letter, role, text, before, _ in edits:
        if letter != "D":
            digest.update((f"{role}:{text}" if before == EMPTY else f"\n{role}:{text}").encode())
    return digest


class Repair:
    """One conversation's repair, fed row by row.

    Of all rows but the last chunk it keeps, for each state, the lightest derivation: cost, audit
    and the hash of the repaired rows.  What it holds besides the audits has a bound.
    """

    def __init__(self) -> None:
        self.items = {EMPTY: (0, (None, ""), hashlib.sha256())}
        self.rows: list[Row] = []

    def feed(self, row: Row) -> None:
        if len(self.rows) == CHUNK:
            self._chunk(to_goal=False)
        self.rows.append(row)

    def _chunk(self, to_goal: bool) -> None:
        starts = {state: (item[0], rank) for rank, (state, item) in enumerate(self.items.items())}
        after = {}
        # in the order of their audits: that of the starts, then of the chunk's letters
        ends = sorted(derive(starts, self.rows, to_goal).items(), key=lambda e: e[1][1:3])
        for state, (cost, _, audit, start) in ends:
            _, before, digest = self.items[start]
            after[state] = (cost, (before, audit), _hashed(digest, apply(audit, start, iter(self.rows))))
        self.items, self.rows = after, []

    def goal(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the lightest derivation of a whole conversation."""
        self._chunk(to_goal=True)
        cost, audit, digest = self.items[GOAL]
        parts = []
        while audit is not None:
            audit, part = audit
            parts.append(part)
        return cost, "".join(reversed(parts)), digest.hexdigest()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turn, role, text, fault) of ordered rows; role is None where there is no row."""
    last = None
    for batch in batches:
        for conv, turn, role, text, present, blank, cut, again in zip(*(c.to_pylist() for c in batch.columns[:8]), strict=True):
            if not present:
                yield conv, None, None, None, None
                continue
            # equal rows of one turn are neighbours, those of a later turn are marked
            repeated = again or (conv, turn, role, text) == last
            fault = "blank" if blank else "duplicate" if repeated else "truncated" if cut else None
            last = (conv, turn, role, text)
            yield conv, turn, role, text, fault


class Reader:
    """Counts and repair of one conversation, row by row."""

    def __init__(self, conv) -> None:
        self.conv, self.repair = conv, Repair()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.least = self.most = self.initial = None

    def read(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        self.repair.feed((role, text, fault in ("blank", "duplicate"), fault == "truncated"))

    def plan(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv, gaps, *self.counts.values(), self.illegal, *self.repair.goal())


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batch = next(batches, None)
    if batch is None:
        return
    kinds = [batch.schema.field(0).type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def packed(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    done, now = [], None
    for conv, turn, role, text, fault in _faults(chain([batch], batches)):
        if now is None or conv != now.conv:
            if now is not None:
                done.append(now.plan())
            if len(done) == BATCH:
                yield packed(done)
                done = []
            now = Reader(conv)
        if role is not None:
            now.read(turn, role, text, fault)
    if now is not None:
        yield packed([*done, now.plan()])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows from ordered rows, each conversation's behind a row that holds its audit."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            kinds.append(batch.schema.field(0).type)
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def packed(done: list[tuple]) -> pa.RecordBatch:
        types = [kinds[0], pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*done, strict=True), types, strict=True)],
            ["conv_id", "position", "turn", "edit", "role", "text"],
        )

    kinds: list[pa.DataType] = []
    done, source = [], rows()
    for conv, _, _, audit, *_ in source:
        # the rows that the edits consume follow directly
        consumed = ((r[2], r[3], r[1]) for r in source)
        position = 0
        for letter, role, text, _, row in apply(audit, EMPTY, consumed):
            if letter == "D":
                continue
            done.append((conv, position, row and row[2], letter, role, text))
            position += 1
            if len(done) == BATCH:
                yield packed(done)
                done = []
    if done:
        yield packed(done)


def ordered(rows: DataFrame, present: str | None = None) -> DataFrame:
    """Rows of conversations with their faults' marks, a conversation's rows in order in one task.

    Order is by turn, nulls first, then by role and text.  Rows seen in an earlier turn are found
    by counting digests of (conversation, role, text) before anything is moved, and only digests
    that come more than once are looked up.
    """
    conv = F.col("conv_id").cast("string")
    here = F.col(present) if present else F.lit(True)
    of = F.concat_ws(
        ":", conv.isNull().cast("string"), F.length(conv), conv, F.length("role"), "role", "text"
    )
    rows = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
        here.alias("present"),
    )
    body = F.btrim("text", F.lit(ASCII_SPACE))
    rows = rows.select(
        "*",
        (body == "").alias("blank"),
        (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.sha2(of.cast("binary"), 256).alias("key"),
    )
    seen = (
        rows.where("present")
        .groupBy("key")
        .agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last"))
        .where("NOT first.turn <=> last.turn")
        .select("key", "first")
    )
    found = rows.join(small_enough(stage(seen, "seen")), "key", "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return (
        found.select("conv_id", "turn", "role", "text", "present", "blank", "cut", again.alias("again"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    )


def plans(rows: DataFrame, present: str | None = None) -> DataFrame:
    """conv_id, faults, cost and audit of the cheapest repair, and its hash, of every conversation.

    `rows` has conv_id, turn, role and text; other columns are not read.  Where the column
    `present` is false there is no row, but its conversation is listed.  Null role and text are
    one space; a null conv_id is a conversation; rows without turn come first and leave no gap.
    A row's first fault counts: blank, duplicate (role and text were seen before), truncated (does
    not end in . ! or ?).

    Edits: keep 0, rerole to user or assistant 2, delete 3 (blank and duplicate rows have to go),
    insert an empty user or assistant row 2; a truncated row that stays adds 1.  The repaired roles
    begin with s at most once, and then u and a alternate, or nothing is left.  `audit` has the
    edits' initials, the least of those that cost least.

    A conversation is read as a stream: a task holds a chunk of its rows, its audits and four
    hashes.  Its rows are not spread, as the hash of the whole has an order.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    schema = f"conv_id {kind}, {counts}, audit string, repaired_sha256 string"
    return ordered(rows, present).mapInArrow(_plans, schema)


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, position, turn, edit, role and text of the repaired rows, by the audits of plans().

    Inserted rows have no turn.  Audits and rows meet by sorting, so no task holds a conversation.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
        F.lit(1).alias("kind"),
    )
    audits = planned.select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
        F.lit(0).alias("kind"),
    )
    both = rows.unionByName(audits).repartition("conv_id")
    both = both.sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "text")
    return both.mapInArrow(
        _edits, f"conv_id {kind}, position long, turn long, edit string, role string, text string"
    )


def damaged(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """Rows with faults put in by the checksum of `conv_id:turn`, modulo `kinds`; null is one space.

    0 drops the row (`present` is false), 1 empties its text, 2 removes . ! and ?, 3 repeats
    it, 4 makes its role user.
    """

    def text(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % kinds
    body = F.when(fault == 1, "").when(fault == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    times = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(text("role")).alias("role"),
        body.alias("text"),
        (fault != 0).alias("present"),
        F.explode(times).alias("copy"),
    ).drop("copy")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans(damaged(table(spark, sf_dir, "conversations")), "present")


OP13_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_concat([4294967295::UBIGINT], list_transform(regexp_extract_all(hex(encode(
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'),
           lambda b: ('0x' || b)::UBIGINT)) AS codes
  FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(codes, lambda crc, b: list_reduce(
           list_concat([xor(crc, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)),
           4294967295::UBIGINT) % 20 AS fault
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, range(2) copies(k) WHERE fault <> 0 AND (k = 0 OR fault = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged
), faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), steps(before, letters, initial, after, cost, wrote) AS (
  -- inserts in front of a row that stays, and the row's own edit; 0 nothing, 1 s, 2 ends in u, 3 ends in a
  VALUES (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (0, 'R', '', 2, 2, 'user'),
         (0, 'IK', 'a', 3, 2, ''), (0, 'IR', '', 3, 4, 'assistant'),
         (1, 'K', 'u', 2, 0, ''), (1, 'R', '', 2, 2, 'user'), (1, 'IK', 'a', 3, 2, ''), (1, 'IR', '', 3, 4, 'assistant'),
         (2, 'K', 'a', 3, 0, ''), (2, 'R', '', 3, 2, 'assistant'), (2, 'IK', 'u', 2, 2, ''), (2, 'IR', '', 2, 4, 'user'),
         (3, 'K', 'u', 2, 0, ''), (3, 'R', '', 2, 2, 'user'), (3, 'IK', 'a', 3, 2, ''), (3, 'IR', '', 3, 4, 'assistant'),
         (0, 'D', '', 0, 3, ''), (1, 'D', '', 1, 3, ''), (2, 'D', '', 2, 3, ''), (3, 'D', '', 3, 3, '')
), paths AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS kept FROM counted
  UNION ALL
  SELECT conv_id, i, state, cost, audit, kept FROM (
    SELECT p.conv_id, f.i, s.after AS state,
           p.cost + s.cost + CASE WHEN f.fault = 'truncated' AND s.letters <> 'D' THEN 1 ELSE 0 END AS cost,
           p.audit || s.letters AS audit,
           CASE WHEN s.letters = 'D' THEN p.kept ELSE list_concat(p.kept,
             CASE WHEN s.letters[1] = 'I' THEN [CASE WHEN p.state = 2 THEN 'assistant:' ELSE 'user:' END] ELSE []::VARCHAR[] END,
             [CASE WHEN s.wrote = '' THEN f.role ELSE s.wrote END || ':' || f.text]) END AS kept,
           row_number() OVER (PARTITION BY p.conv_id, s.after ORDER BY
             p.cost + s.cost + CASE WHEN f.fault = 'truncated' AND s.letters <> 'D' THEN 1 ELSE 0 END,
             p.audit || s.letters) AS place
    FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
    JOIN steps s ON s.before = p.state AND (s.initial = '' OR s.initial = left(f.role, 1))
      AND (s.letters = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  ) WHERE place = 1
), ends AS (
  SELECT p.conv_id, p.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost,
         audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
         array_to_string(list_concat(kept, CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:']
           ELSE []::VARCHAR[] END), chr(10)) AS whole
  FROM paths p JOIN (SELECT conv_id, max(i) AS n FROM faults GROUP BY conv_id) l
    ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.n = p.i
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS place FROM ends) WHERE place = 1
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank,
       coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
       coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit,
       sha256(coalesce(b.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""
