"""Source divergence, sharding and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from moodspark.llm import common, conversations, divergence, sharding
from moodspark.llm.common import stage

# --- source divergence


def divergence_by_hand(rows, min_docs=10, top=10):
    groups, docs, counts = set(), Counter(), Counter()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)
        for t in terms:
            counts[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        p = {}
        for s in [*sources, None]:
            n = {t: sum(counts[lang, o, t] for o in ([s] if s is not None else sources)) for t in kept}
            p[s] = {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], p[None][t])) for t in kept if counts[lang, s, t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def source_rows():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("alpha", "Beta", "gämma", "ΔELTA", "ÉTÉ") for b in "abcdefgh"]
    rows = []
    for k in range(400):
        weights = [1 + (i * (k % 7)) % 11 for i in range(len(words))]
        text = rng.choice([" ", "-", "\n", "3"]).join(rng.choices(words, weights, k=rng.randint(0, 30)))
        rows.append((text, ["en", "de", None][k % 3], f"s{k % 7}" if k % 5 else None))
    rows += [(None, "xx", "only"), ("", "xx", "other"), ("12 34", "yy", "a"), ("word " * 100_000, "en", "hot")]
    rows += [("the same", "en", "hot")] * 300  # a group of repeated rows, and ties
    return rows


def test_divergence_is_brute_force(spark, monkeypatch):
    rows = source_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string")
    want = divergence_by_hand(rows)
    got = divergence.divergences(stage(divergence.term_counts(df), "counts")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    # several blocks of sources and many shards
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "SHARD_ROWS", 40)
    got = divergence.divergences(stage(divergence.term_counts(df.repartition(13)), "counts")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert divergence.divergences(divergence.term_counts(df.limit(0))).collect() == []


def test_partial_counts_add_up_whatever_the_batches(monkeypatch):
    import pyarrow as pa

    rows = [(t or "", a or "", b or "") for t, a, b in source_rows()]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["text", "lang", "source"])

    def total(held, size, rows_held):
        monkeypatch.setattr(divergence, "TEXT_BYTES", size)
        monkeypatch.setattr(divergence, "HELD_ROWS", rows_held)
        found = Counter()
        for part in divergence.partial_counts(iter(held)):
            for r in part.to_pylist():
                found[r["lang"], r["source"], r["term"], "n"] += r["n"]
                found[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return found

    whole = total([batch], 1 << 30, 1 << 30)
    assert total([batch.slice(k, 7) for k in range(0, len(batch), 7)], 100, 20) == whole


def test_shares_are_exact_for_large_counts():
    whole = np.array([divergence.MOST_TERMS, 10**12 + 7, 3])
    count = np.array([divergence.MOST_TERMS - 5, 123_456_789_012, 2])
    want = [1 + 10**9 * int(c) // int(w) for c, w in zip(count, whole, strict=True)]
    assert divergence.share(count, whole).tolist() == want


# --- sharding


def jump_by_hand(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.array([0, 1, 2, -1, 2**63 - 1, -(2**63), *range(5, 90_000, 3)])
    for shards in (1, 2, 8, 9, 1000):
        got = sharding.jump(keys, shards)
        assert got[:500].tolist() == [jump_by_hand(int(k), shards) for k in keys[:500]]
        held = np.bincount(got, minlength=shards)
        assert len(held) == shards and abs(held - len(keys) / shards).max() < 6 * (len(keys) / shards) ** 0.5 + 6
    before, after = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(after[before != after]) == {8}
    assert abs((before != after).mean() - 1 / 9) < 0.01


def test_documents_are_placed(spark):
    rows = [(k, f"text {k}" * (k % 40)) for k in range(600)]
    rows += [(None, "no id"), (None, None), (3, "other"), (5, ""), (7, None), (11, "é" * 300_000)] + [(9, "again")] * 400
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, shard string, slot int, row int")
    got = sharding.place_documents(df, 8).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode())
    want = Counter((i, size(t) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        assert (r.law, r.shard, r.grown_shard) == ("key", jump_by_hand(r.doc_id or 0, 8), jump_by_hand(r.doc_id or 0, 9))
        held[r.shard].append((r.slot, r.doc_id is not None, r.doc_id, r.size, r.text_crc32))
    for shard in held.values():
        assert [r[0] for r in sorted(shard)] == list(range(len(shard)))
        assert sorted(shard) == sorted(shard, key=lambda r: (r[1], r[2] or 0, r[3], r[4], r[0]))
    assert sharding.place_documents(df.limit(0), 8).collect() == []


def test_shards_of_any_key_are_written_and_grow(spark, tmp_path):
    df = spark.createDataFrame([(f"k{k}", k % 3 if k % 5 else None, "keep") for k in range(900)], "a string, b int, shard string")
    placed = sharding.with_slots(sharding.assign(df.drop("shard"), 4, "a", "b"), ["a"])
    sharding.write_shards(placed, f"{tmp_path}/shards", rows_in_file=50)
    back = spark.read.parquet(f"{tmp_path}/shards").select(*placed.columns)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, placed.collect()), key=str)
    gone = sharding.moved(df, 4, 6, "a", "b")
    assert 0 < gone.where("shard < to_shard AND to_shard >= 4").count() == gone.count() < 450


# --- conversations


def fold(key):
    return zlib.crc32(key.encode()) % 20


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = fold(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}")
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def marked(rows):
    """(role, text, fault) in order."""
    out, seen = [], set()
    for _, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())):
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        out.append((role, text, fault))
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edits of all rows with up to two inserts anywhere, the least (cost, audit) that is well formed."""
    inserts = ["", "I", "II"]
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and r[2] in ("blank", "duplicate") for e, r in zip(edits, rows, strict=True)):
            continue
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            audit = put[0] + "".join(e + p for e, p in zip(edits, put[1:], strict=True))
            if best and 2 * audit.count("I") + 2 * audit.count("R") + 3 * audit.count("D") > best[0]:
                continue
            cut = sum(e != "D" and r[2] == "truncated" for e, r in zip(edits, rows, strict=True))
            cost = 2 * audit.count("I") + 2 * audit.count("R") + 3 * audit.count("D") + cut
            if best and (cost, audit) >= best[:2]:
                continue
            for wanted in ("user", "assistant"):
                out, left, free = [], iter(rows), wanted
                for e in audit:
                    row = None if e == "I" else next(left)
                    if e == "D":
                        continue
                    if e == "K":
                        out.append((row[0], row[1]))
                    else:  # what is free alternates with what stands before it
                        role = free if not out else "assistant" if out[-1][0][:1] == "u" else "user"
                        out.append((role, "" if row is None else row[1]))
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                    best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def plans_by_hand(rows):
    out, after = {}, defaultdict(list)
    for r in damaged_by_hand(rows):
        after[r[0]].append(r)
    for conv in {r[0] for r in rows}:
        here = marked(after[conv])
        turns = [r[1] for r in after[conv] if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = Counter(r[2] for r in here)
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(here)]
        cost, audit, text = cheapest(here)
        out[conv] = (
            gaps, faults["blank"], faults["duplicate"], faults["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def conversation_rows():
    rng = random.Random(9)
    texts = ["Yes.", "No", "What now?", "", None, " \t", "Go!", "Étude\n", "so. "]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "unknown"]
    rows = []
    for conv in [None, *range(150)]:
        start, well = rng.randint(-2, 3), rng.random() < 0.4
        for k in range(rng.randint(1, 5)):
            turn = None if rng.random() < 0.05 else start + k * rng.choice([1, 1, 1, 2])
            role = ["user", "assistant"][k % 2] if well else rng.choice(roles)
            rows.append((conv, turn, role, rng.choice(texts)))
    return rows + rows[:12]


def test_repairs_are_brute_force(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, True, "x") for r in rows], "conv_id long, turn long, role string, text string, present boolean, key string")
    planned = stage(conversations.plans(conversations.damaged(df), "present"), "plans")
    got = {r[0]: tuple(r)[1:] for r in planned.collect()}
    want = plans_by_hand(rows)
    assert planned.count() == len(want) and got == want
    # the repaired rows themselves
    left = conversations.damaged(df).where("present").drop("present")
    held = defaultdict(list)
    for r in conversations.repaired(left, planned).collect():
        held[r.conv_id].append((r.position, f"{r.role}:{r.text}", r.edit))
    for conv, plan in got.items():
        repaired = sorted(held[conv])
        assert [r[0] for r in repaired] == list(range(len(repaired)))
        assert hashlib.sha256("\n".join(r[1] for r in repaired).encode()).hexdigest() == plan[-1]
        assert "".join(r[2] for r in repaired) == plan[-2].replace("D", "")
    assert conversations.plans(df.limit(0)).collect() == []


def test_chunks_are_one_derivation():
    rng = random.Random(2)
    for n in (conversations.CHUNK - 1, conversations.CHUNK, 3 * conversations.CHUNK + 17):
        rows = []
        for k in range(n):
            role = rng.choice(["user", "assistant", "system", "x"]) if rng.random() < 0.2 else ["user", "assistant"][k % 2]
            rows.append((role, f"t{k}", rng.random() < 0.05, rng.random() < 0.1))
        cost, _, audit, _ = conversations.derive({conversations.EMPTY: (0, 0)}, rows, True)[conversations.GOAL]
        edits = conversations.apply(audit, conversations.EMPTY, iter(rows))
        text = "\n".join(f"{role}:{text}" for letter, role, text, *_ in edits if letter != "D")
        repair = conversations.Repair()
        for row in rows:
            repair.feed(row)
        assert repair.goal() == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_a_conversation_of_a_third_of_all_rows(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"turn {k}.") for k in range(20_000)]
    rows += [(k, t, "user", "same") for k in range(2, 10_002) for t in (0, 1, 0, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in conversations.plans(df).where("conv_id < 5").collect()}
    assert (got[1].cost, got[1].audit) == (0, "K" * 20_000)
    assert (got[2].duplicate, got[2].truncated, got[2].cost, got[2].audit, got[2].gaps) == (3, 1, 12, "DDDD", 0)


def test_stages_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "_stage_root", lambda spark: f"{tmp_path}/stages")
    assert stage(spark.range(3), "x").count() == 3 and list(tmp_path.glob("stages/x-*"))
    common.remove_stages(spark)
    assert not list(tmp_path.iterdir())
