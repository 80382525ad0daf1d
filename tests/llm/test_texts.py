"""Operators on texts against brute force, accuracy and round trips."""

import hashlib
import math
import random
import re
import textwrap
import time
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moodspark.llm import compression, licenses, lines, packing, personal, templates, toxicity, urls
from moodspark.llm.common import stage

ROWS = [(1, None), (2, ""), (None, "a line that is long enough to be counted as one line"), (3, "x" * 200_000)]
SCHEMA = "doc_id long, text string"


def docs_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_lines(spark):
    shared = "This line is shared by more than five of the documents"
    rows = [(k, f"own {k}\n  {shared.upper() if k % 2 else shared}\t\n{shared}\nend", 7) for k in range(1, 7)]
    rows += [(2, f"repeated row\n{shared}", 7), (None, shared, 7), (20, None, 7), (21, "", 7), (22, "short\n" * 9, 7)]
    got = lines.drop_repeated_lines(docs_of(spark, rows, SCHEMA + ", n_lines int"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    found = sorted(map(tuple, got.collect()), key=str)
    want = [(k, f"own {k}\nend", 4, 2) for k in range(1, 6)]
    want += [(6, rows[5][1], 4, 0), (2, "repeated row", 2, 1), (None, shared, 1, 0)]
    want += [(20, "", 1, 0), (21, "", 1, 0), (22, "short\n" * 9, 10, 0)]
    assert found == sorted(want, key=str)
    assert lines.drop_repeated_lines(docs_of(spark, [])).count() == 0


def test_lines_keep_columns_of_any_name(spark):
    shared = "This line is shared by more than five of the documents"
    names = ["of_doc", "_of_doc", "lost_lines", "lines_that_stay", "id", "line", "last", "n"]
    rows = [(k, f"{k}\n{shared}", *(f"{k}{c}" for c in names)) for k in range(6)]
    df = spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in names))
    got = lines.drop_repeated_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    want = [(r[0], str(r[0]) if r[0] < 5 else r[1], *r[2:], 2, int(r[0] < 5)) for r in rows]
    assert sorted(map(tuple, got.collect())) == want


def test_packing_of_long_runs(spark):
    """Runs that the fast encoder's pattern cannot take go to the file's own tokenizer."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encode = Tokenizer.from_file(path), packing.Encoder(path)
    for run in ("\n", " ", "\t", " \n", "\u3000"):
        text = "before" + run * 1_000_000 + "after " + run * 10
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(encode("x" * 1_000_000)) > 0 and len(encode("1" * 300_000)) > 0
    got = packing.pack_documents(docs_of(spark, [(1, "\n" * 1_000_000), (2, "x")])).agg({"length": "sum"}).first()[0]
    assert got == len(whole.encode("\n" * 1_000_000, add_special_tokens=False).ids) + len(whole.encode("x", add_special_tokens=False).ids) + 2


def test_packing_of_repeated_rows_and_columns_of_any_name(spark):
    names = ["_shard", "_bin", "_fill", "c0", "row", "bin", "place", "fill", "shard", "sequence_id"]
    rows = [(None, 7, *(c for c in names))] * 30_000 + [(k, 1000, *(c for c in names)) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, length long" + "".join(f", `{c}` string" for c in names)).repartition(4)
    got = packing.pack(stage(df, "rows"), 1024, shard=5_000)
    assert got.columns == [*df.columns[:-1], "sequence_id", "offset"]
    placed = got.groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).collect()
    assert got.count() == len(rows) and max(r[1] for r in placed) <= 1024
    assert len(placed) <= -(-(30_000 * 7 + 50 * 1000) // 1024) + 3
    assert got.where("_bin = '_bin' AND fill = 'fill' AND row = 'row'").count() == len(rows)


def test_packing_is_a_round_trip(spark):
    rng = random.Random(1)
    texts = ["", None, "a  b\n\n c", "<|endoftext|> x", "naïve 漢字 👍", " lead", "tail ", "it's 12,5%\tok"]
    texts += [" ".join(rng.choice(["alpha", "be", "gamma,", "x1"]) for _ in range(rng.randint(1, 3000))) for _ in range(60)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(5, " lead", "x"), (None, "no id", "x")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs_of(spark, rows, SCHEMA + ", piece string")).collect()
    whole = Tokenizer.from_file(path)
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, {}).setdefault(r.piece, []).append(r)
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= 1024
        assert r.length == 1024 or r.piece == 0
    for k, t, _ in rows:
        ids = b"".join(bytes(pieces[k][p][0].ids) for p in sorted(pieces[k]))
        assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 2]
    assert len(pieces[5][0]) == 2
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 1024) + 2
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


def test_packing_in_several_rounds(spark):
    rng = random.Random(2)
    rows = [(k % 50, k, rng.randint(1, 1024)) for k in range(3_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), shard=300).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted(rows)
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in fill.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(fill) <= 1.02 * sum(r[2] for r in rows) / 1024 + 1


def test_packing_of_bins_that_never_fill(spark, monkeypatch):
    plain = packing._pack

    def bounded(size, at):
        run = plain(size, at)

        def checked(keys, group):
            assert group.num_rows <= 600, group.num_rows
            return run(keys, group)

        return checked

    monkeypatch.setattr(packing, "_pack", bounded)
    rng = random.Random(7)
    rows = [(k, 0, rng.choice([600, 600, 1000, 300])) for k in range(2_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), shard=150).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == rows
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in fill.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    counts = [sum(r[2] == n for r in rows) for n in (1000, 600, 300)]
    least = counts[0] + counts[1] + max(0, -(-(counts[2] - counts[1]) // 3))
    assert len(fill) <= 1.02 * least + 1


def test_swaps_raise_squared_fill():
    rng = random.Random(3)
    lengths = [rng.randint(200, 900) for _ in range(400)]
    order = list(range(400))
    bins = [order[k : k + 1] for k in range(400)]
    better = packing.swap_search(bins, lengths, 1024)
    fills = [sum(lengths[k] for k in b) for b in better]
    assert sorted(k for b in better for k in b) == order and max(fills) <= 1024
    assert sum(f * f for f in fills) > sum(n * n for n in lengths) and len(better) < 330


def test_templates(spark):
    items = [
        (1, "A train travels 120 miles in 3 hours while Maria walks 120 meters. How far does Maria go when it stops?"),
        (2, "short one item"), (3, None), (4, ""), (None, "nothing to see here at all, is there"),
    ]
    rows = [
        (10, "Before. A train travels 85 km in 7 days while Jonas walks 85 miles. How far does Jonas go when it stops? x"),
        (11, "A train travels 85 km in 7 days while Jonas walks 99 miles. How far does Peter go when it stops?"),
        (12, "so SHORT, one\nitem!"), (13, "short two item"), (14, None), (15, ""), (None, "short one item"),
        (16, items[0][1].lower()), (16, items[0][1]), (17, "word " * 50_000),
    ]
    docs = docs_of(spark, [(*r, 1) for r in rows], SCHEMA + ", item_id int")
    bench = spark.createDataFrame([(*r, 1) for r in [*items, items[0]]], "item_id long, text string, doc_id int")
    got = templates.leaks(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(10, 1), (12, 2), (16, 1)}
    assert templates.leaks(docs, bench.limit(0)).count() == 0
    assert templates.leaks(docs.limit(0), bench).count() == 0


def test_templates_of_word_problems(spark):
    item = (
        "Maria has 3 apples in a box. Maria buys 5 more apples at the shop. Maria gives 2 apples to her friend. "
        "How many apples does Maria have now?"
    )
    other = item.replace("Maria", "Jonas").replace("3", "7").replace("5", "9").replace("2", "4")
    spoken = other.replace("7", "seven").replace("9", "one").replace("4", "twelve")
    rows = [(1, other), (2, spoken), (3, "Jonas likes the sea. Jonas buys fish at the shop. How many fish does Jonas have now?")]
    got = templates.leaks(docs_of(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {1, 2}


def test_templates_keep_what_matches(spark):
    words = lambda name, n: " ".join(f"{name}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n))
    named = f"{words('p', 40)} then 12 {words('q', 40)} then 12 {words('r', 40)} then 12 {words('s', 20)}"
    roles = "they sell 2 apples from the old garden behind the house and they also want 2 dollars from each child who comes along"
    items = [(1, named), (2, roles), (3, words("x", 300)), (4, words("y", 20))]
    rows = [
        (1, named.replace("12 qaa", "13 qaa")), (2, roles.replace("2 apples", "3 apples").replace("2 dollars", "5 dollars")),
        (3, "some " + " ".join(items[2][1].split()[100:200]) + " more"), (4, items[3][1].replace("yak", "other")),
        (6, " ".join(items[2][1].split()[:12])),
    ]
    got = templates.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_templates_leave_clean_documents_alone(spark):
    """Capitals tell no names in title case and in German; templates of nothing but placeholders match nothing."""
    items = [
        (1, "Who Wrote The Famous Novel About White Whales"),
        (2, "Der Hund läuft heute durch den Park und der Vogel sitzt auf dem Dach"),
        (3, "In 3 Tagen fahren 12 Züge von Berlin über Hannover nach Köln und halten dort 20 Minuten"),
        (4, "Anna, Bert, Carl, Dora, Emil and Fritz met Gustav, Hanna and Ida"),
    ]
    rows = [
        (1, "Breaking News Today Local Council Approves New Budget"),
        (2, "Der Mann läuft heute durch den Wald und der Lehrer sitzt auf dem Stuhl"),
        (3, "In 7 Tagen fahren 90 Züge von Berlin über Hannover nach Köln und halten dort 15 Minuten"),
        (4, "Peter, Paul, Mary, John, Ringo and George saw Kurt, Krist and Dave"),
        (5, "WHO WROTE the famous novel about white whales?"),
    ]
    got = templates.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(3, 3), (5, 1)}


def test_windows_are_brute_force(spark):
    """Windows word for word, of all widths, against a plain search of word sequences."""
    rng = random.Random(8)
    words = [f"w{c}" for c in "abcdefghijkl"]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 14)))) for k in range(60)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 120)))) for k in range(60)]
    rows += [(100 + k, f"{rows[k][1]} {t} {rows[k][1]}") for k, t in items]
    want = set()
    for i, t in items:
        item = t.split()
        w = min(8, len(item))
        parts = [tuple(item[k : k + w]) for k in range(len(item) - w + 1)]
        for d, text in rows:
            doc = text.split()
            there = {tuple(doc[k : k + w]): k for k in range(len(doc) - w + 1)}
            matched = [k for k, p in enumerate(parts) if p in there]
            covered = {p for k in matched for p in range(k, k + w)}
            if 2 * len(matched) >= len(parts) and matched or 2 * len(covered) >= len(item) and matched:
                want.add((d, i, len(parts), len(matched)))
    got = templates.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.n_windows, r.n_matched) for r in got.collect()} == want


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(last[j + 1] + 1, now[j] + 1, last[j] + (x != y)))
        last = now
    return last[-1]


def test_matcher_is_edit_distance():
    rng = random.Random(4)
    terms = ["scum", "idiot", "worthless", "moron", "considerately"]
    find = toxicity.Matcher(terms)
    words = [*terms, "", "x", "idoit", "idiots", "idot", "mor0n", "worthles", "scums", "considerrattely"]
    for _ in range(2_000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "o", "é"])
        words.append("".join(word))
    for word in words:
        near = [(edit_distance(word, t), t) for t in terms if edit_distance(word, t) <= toxicity.edits_allowed(t)]
        assert find(word) == ((min(near)[1], min(near)[0]) if near else None), word


def test_quotation_scores_less():
    find = toxicity.Matcher(["idiot", "moron"])
    score = lambda text: sum(s for *_, s in toxicity.hits(text, find))
    assert score("you idiot") == 1.0 and score("you idoit") < 1.0 and score("nobody here") == 0
    assert score('they read "idiot" aloud') == 0.25 and score("she said idiot") == 0.25
    assert score("idiot and moron") == 2.5


def toxic_tables(spark):
    rng = random.Random(5)
    plain = [f"p{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"]
    bad = ["vobulos", "grunteky", "slarpion"]
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        toxic = k % 6 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic), int(not toxic)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_learns_the_terms(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit(docs, labels)
    assert set(model.terms) == {"vobulos", "grunteky", "slarpion"}
    assert {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted} == set(range(0, 600, 6))
    odd = docs_of(spark, [*ROWS, (4, "pak pal VOBULOS paq vobulas pak slarpion"), (4, "pak pal")])
    got = [(r.doc_id, r.predicted) for r in toxicity.score(odd, model).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (None, 0), (3, 0), (4, 1), (4, 0)], key=str)
    assert toxicity.clean(odd, model).count() == 5 and toxicity.score(odd.limit(0), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert not any(r.predicted for r in toxicity.score(odd, nothing).collect())


def test_compression_tells_junk(spark):
    rng = random.Random(6)
    syllables = ["tion", "an", "the", "er", "ing", "re", "st", "en", "ed", "or", "ti", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    good = [" ".join(word() for _ in range(rng.randint(40, 200))) for _ in range(300)]
    bad = [" | ".join(word().upper() + "!!" for _ in range(rng.randint(30, 150))) for _ in range(120)]
    rows = list(enumerate(good + bad))
    labels = spark.createDataFrame([(k, int(k < 300), None) for k, _ in rows] + [(None, 1, 1)], "doc_id long, quality int, x int")
    docs = docs_of(spark, rows)
    model = compression.fit(docs, labels)
    got = {r.doc_id: r for r in compression.score(docs, model).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(got[k].predicted == (k < 300) for k in held) >= 0.97 * len(held)
    odd = compression.score(docs_of(spark, ROWS), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd)
    assert compression.score(docs.limit(0), compression.fit(docs, labels.limit(0))).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(digits[::-1])]
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(n // 10 + n % 10 for n in doubled) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), list(PATTERNS).index(kind), kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_base_spans_are_the_patterns():
    rng = random.Random(8)
    parts = ["a", "b.c", "@", ".", "-", " ", "+", "1", "23", "255", "4539578763621486", "(", ")", "x@y.z", "1.2.3.4", "é"]
    for _ in range(6_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert personal.base_spans(text) == plain_base(text), text


def test_personal_data(spark):
    rng = random.Random(9)
    texts = []
    for k in range(300):
        n = lambda d: "".join(rng.choice("0123456789") for _ in range(d))  # noqa: E731, B023
        kind = k % 4
        inside = [
            f"u{n(2)}.x@mail{n(1)}.example.com", f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{n(2)}.{n(1)}",
            next(c for c in (f"4{n(15)}" for _ in range(999)) if personal.luhn(c)), f"+1 ({n(3)}) 555-{n(4)}",
        ][kind]
        texts.append(f"words before {inside} and words after")
    model = personal.fit(docs_of(spark, list(enumerate(texts))))
    hidden = "write to ann.lee [at] mail [dot] example [dot] com or call (415) 555-0134 today"
    rows = [(1, "see a@b.co\nand 10.0.0.1"), (2, None), (3, ""), (None, "x@y.org"), (4, "9" * 30_000), (5, hidden)]
    got = {r.doc_id: r for r in personal.find(docs_of(spark, [*rows, (6, "no numbers")]), model).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].base) == (1, 1, "email:4:10,ip:15:23")
    assert got[1].redacted == "see <email>\nand <ip>" and got[None].redacted == "<email>"
    assert got[2].spans == got[3].spans == got[4].spans == got[6].spans == ""
    assert got[5].base == "" and "ann.lee" not in got[5].redacted and "0134" not in got[5].redacted
    assert hashlib.sha256(got[2].base.encode()).hexdigest().startswith("e3b0c442")
    assert personal.find(docs_of(spark, []), personal.fit(docs_of(spark, []))).count() == 0


def test_number_groups_are_proposed_whole():
    for kind, number in [
        ("phone", "00 49 30 12 34 56 78"), ("phone", "00 33 6 12 34 56 78"), ("card", "45.39.57.87.63.62.14.86"),
    ]:
        text = f"call {number} today"
        assert (kind, 5, 5 + len(number)) in personal.candidates(text)


def test_urls(spark):
    rows = [
        (1, "http://a.example.net/fr/1", '<link rel="canonical" href="https://x.test/1">'), (2, "https://x.test/1#top", None),
        (3, "https://X.test/1", '<meta http-equiv="refresh" content="0; url=/2">'), (4, "https://x.test/2", ""),
        (5, "https://q.test/", None), (6, None, '<link rel=canonical href="http://z.net/">'), (7, "nourl", ""),
        (8, "https://m.example.net/en/z", "<link rel=canonical href=https://y.test/9>"), (9, "https://y.test/9", ""),
        (10, "https://b.net/7", "<link rel=canonical href=https://y.test/9>"), (11, "HTTPS://A.Example.COM/de/x?y#z", ""),
        (12, "http://notexample.com/de/", ""), (13, "a://b://c/d", ""), (2, "https://x.test/1#top", None),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == {
        1: ("a.example.net", "/fr/1", "net/", "block"), 2: ("x.test", "/1", None, "block"),
        3: ("x.test", "/1", None, "block"), 4: ("x.test", "/2", None, "block"), 5: ("q.test", "/", None, "allow"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("m.example.net", "/en/z", "example.net/en/", "allow"), 9: ("y.test", "/9", None, "allow"),
        10: ("b.net", "/7", "net/", "block"), 11: ("a.example.com", "/de/x", "example.com/de/", "block"),
        12: ("notexample.com", "/de/", None, "allow"), 13: ("b:", "//c/d", None, "allow"),
    }
    assert urls.judge(pages).count() == len(rows) and urls.judge(pages.limit(0)).count() == 0
    more = spark.createDataFrame([("https://q.test/", "http://bad.net/x")], "url string, target string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, redirects=more).collect()}[5] == "block"


def test_windows_that_only_look_like_an_items(spark):
    """Every window that items have is found, whatever its width; one of two items' halves no longer leaves its row."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    for width in range(1, 9):
        items = [(k, " ".join(rng.choices(words, k=width + 3))) for k in range(4)]
        docs = [(k, " ".join([*rng.choices(words, k=k), items[k % 4][1], *rng.choices(words, k=3)])) for k in range(14)]
        prepared = templates._texts(spark.createDataFrame(items, "item_id long, text string"), "item_id")
        wanted = stage(templates._item_windows(prepared, width, [width]), "test")
        found = templates._found(templates._texts(docs_of(spark, docs), "doc_id"), [width], templates._table_of_parts(wanted))
        got = {(r.doc_id, r.place) for r in found.join(wanted.select("window").distinct(), "window").where("plain").collect()}
        windows = {tuple(t.split()[i : i + width]) for _, t in items for i in range(4)}
        every = ((k, t.split(), i) for k, t in docs for i in range(len(t.split()) - width + 1))
        assert got == {(k, i) for k, x, i in every if tuple(x[i : i + width]) in windows}
    # two halves of windows of eight words
    items = [(1, " ".join(words[:8])), (2, " ".join(words[8:16]))]
    doc = docs_of(spark, [(1, " ".join([*words[20:23], *words[:4], *words[12:16], *words[23:]]))])
    prepared = templates._texts(spark.createDataFrame(items, "item_id long, text string"), "item_id")
    wanted = stage(templates._item_windows(prepared, 8, [8]), "test")
    assert templates._found(templates._texts(doc, "doc_id"), [8], templates._table_of_parts(wanted)).count() == 0


def test_plan_holds_the_table_of_parts_once(spark):
    """Each look-up had its own copy, of up to 65,536 numbers for each width and form of words."""
    docs = templates._texts(docs_of(spark, [(1, "one two three four five six seven eight nine")]), "doc_id")
    found = templates._found(docs, [3, 8], F.from_json(F.lit(str([7001, 7002, 7003, 7004])), "array<bigint>"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("7003") == 1


def test_encoder_reads_the_file_when_it_is_needed():
    """A second tokenizer takes tens of megabytes in each worker; few texts need it."""
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encode("plain words")
    assert "file" not in vars(encode)
    assert encode(f"a {encode.special[0]} b") and "file" in vars(encode)


def test_encoder_takes_texts_whole(monkeypatch):
    """A call for each word that is not remembered took twice the time of whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, whole = packing.Encoder(path), Tokenizer.from_file(path)
    fast, calls = encode.fast, []

    class Counted:
        def encode_ordinary(self, text):
            calls.append(len(text))
            return fast.encode_ordinary(text)

    encode.fast = Counted()
    text = " ".join(f"w{k}rd, é{k}\n漢 \x1cx" if k % 3 else f"it's\u00a0{k}" for k in range(30_000))
    for part, most in ((packing.PART, 10), (1_000, 1_000)):
        monkeypatch.setattr(packing, "PART", part)
        calls.clear()
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert 1 < len(calls) < most and max(calls) < part + 100 and sum(calls) == len(text)
    calls.clear()
    encode(text[:900])
    assert calls == [900]


def test_url_plans_stay_small(spark, monkeypatch):
    """No stage's plan repeats the expressions of links in those of nodes; it had four million characters."""
    sizes = []
    monkeypatch.setattr(
        urls, "stage", lambda df, name: (sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString())), stage(df, name))[1]
    )
    html = '<link rel="canonical" href="/b?x=1&amp;y=2">'
    pages = spark.createDataFrame([(1, "https://a.net/a", html), (2, "https://a.net/b?x=1&y=2#z", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.component_id is None) for r in urls.judge(pages).collect()}
    assert got == {1: ("block", False), 2: ("block", False)}
    assert sizes and max(sizes) < 200_000


def test_urls_of_all_forms(spark):
    rows = [
        (1, "http://a.net/f/p", '<link rel="canonical" href="https://c.test/v?a=1&amp;b=2">'), (2, "https://c.test/v?a=1&b=2", None),
        (3, "https://d.test/f/p", '<link rel=canonical href="../g/./q">'),
        (4, "https://d.test/g/q", '<link rel="canonical" href="/g/q"><link rel="canonical" href="http://b.net/">'),
        (5, "https://e.test", '<meta http-equiv=refresh content="0; url=t">'), (6, "https://e.test/t", "<link rel=canonical href='?z=1'>"),
        (7, "https://e.test/t?z=1", '<meta http-equiv=refresh content="0;url=&#47;u"><meta http-equiv=refresh content="0;url=http://c.net/">'),
        (8, "https://e.test/u", ""), (9, "https://f.test/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages).collect()}
    assert got == dict.fromkeys(range(1, 9), "block") | {9: "allow"}


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    changed = mit.replace("Copyright (c) year holder", "COPYRIGHT 2020 A. Person\n(c) 2021 B").replace('"Software"', "'Software'")
    rows = [
        (1, mit), (2, changed.upper()), (3, mit + " and more"), (4, "x\nReleased under the MIT Licence\ny\nlicensed under cc by 4.0"),
        (5, None), (6, ""), (None, mit), (7, "Copyright 2020"), (1, mit),
    ]
    docs = docs_of(spark, [(*r, "x") for r in rows], SCHEMA + ", license string")
    got = sorted(map(tuple, licenses.scan(docs, licenses.known_licenses(spark)).collect()), key=str)
    want = [(1, "MIT", 0, ""), (1, "MIT", 0, ""), (2, "MIT", 0, ""), (3, None, 0, ""), (4, None, 2, "CC-BY-4.0,MIT")]
    want += [(5, None, 0, ""), (6, None, 0, ""), (None, None, 0, ""), (7, None, 0, "")]
    assert got == sorted(want, key=str)


def test_licenses_whole_and_wrapped(spark):
    wrap = lambda text, n: "\n".join(textwrap.fill(x, n) for x in text.split("\n"))
    known = dict(licenses.WHOLE)
    isc = licenses.KNOWN[2][1].replace("above copyright", "above\ncopyright")
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    rows = [(k, known[x].replace("year holder", "2024, Some Body")) for k, x in enumerate(names)]
    rows += [(20, isc), (21, wrap(known["BSD-3-Clause"], 60)), (22, wrap(isc, 75)), (23, known["MPL-2.0"][:-400])]
    got = {r.doc_id: r.license for r in licenses.scan(docs_of(spark, rows), licenses.known_licenses(spark)).collect()}
    assert got == dict(enumerate(names)) | {20: "ISC", 21: "BSD-3-Clause", 22: "ISC", 23: None}


def test_long_texts_take_time_in_proportion():
    """Two megabytes on one line with 32,000 hits, in each of the classifiers."""
    find = toxicity.Matcher(["badterm", "worseterm"])
    marks = ' "badterm" « badterm said worseterm » and some other words here '
    begun = time.process_time()
    assert len(toxicity.hits(marks * 11_000, find)) == 33_000
    assert time.process_time() - begun < 4
    model = personal.Finder(personal.Trees(start=3.0), dict.fromkeys(personal.KINDS, 0.5))
    model.trees.trees.append(([0] * 7, [math.inf] * 7, [1.0] * 8))
    begun = time.process_time()
    base, spans = model.spans("call 001 33 6 12 34 or a (at) b.org, x@y.org; " * 8_000)
    assert len(base) == 8_000 and len(spans) >= 24_000
    assert time.process_time() - begun < 12
    sizes = compression.Sizes(b"good words " * 500, b"bad words " * 500)
    begun = time.process_time()
    sizes(b"some words of a long text " * 80_000)
    assert time.process_time() - begun < 4


def test_quotations_are_brute_force():
    rng = random.Random(3)

    def plain(text, start, end):
        low = text.rfind("\n", 0, start) + 1
        high = text.find("\n", end)
        left, right = text[low:start], text[end : high if high >= 0 else len(text)]
        opened = max(map(left.rfind, toxicity.OPENING)) > max(map(left.rfind, toxicity.CLOSING))
        straight = left.count('"') % 2 and '"' in right
        return bool(opened and any(x in right for x in toxicity.CLOSING) or straight)

    for _ in range(300):
        text = "".join(rng.choice('ab“”«»"\n') for _ in range(rng.randint(1, 40)))
        marks = toxicity.Quotations(text)
        for start in range(len(text)):
            assert marks.around(start, start + 1, []) == plain(text, start, start + 1)


def test_hidden_addresses_of_any_length():
    local, label = "a" * 300 + ".b", "c" * 200
    text = f"write to {local} [at] {label}.{label} [dot] d.e.f.g.h soon, not (at) all"
    assert list(personal._hidden_emails(text)) == [("email", 9, text.index(" soon"))]
    taken = personal.Taken([("card", 0, 50), ("phone", 2, 5), ("ip", 60, 70), ("ip", 6, 7)])
    for a in range(80):
        for b in range(a + 1, 81):
            assert taken.overlaps(("ip", a, b)) == (a < 50 or a < 70 and b > 60)
