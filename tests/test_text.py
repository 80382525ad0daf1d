"""Text functions against results written by hand, and against readings letter by letter."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodspark.functions import text as t

# text, cleaned, symbols only, mentions only: written by hand
BY_HAND = [
    ("", "", True, False),
    ("   ", "", True, False),
    ("\n\t\r\x0b\x0c", "", True, False),
    ("\x1c\x1d\x1e\x1f\x85", "", True, False),
    ("👍", "👍", True, False),
    ("❤️", "❤️", True, False),
    ("1️⃣", "1️⃣", False, False),
    ("_", "_", False, False),
    ("²", "²", False, False),
    ("①", "①", False, False),
    ("\u0301", "\u0301", True, False),
    ("!!! ???", "!!! ???", True, False),
    ("  ten chars ", "ten chars", False, False),
    ("@one", "", False, True),
    ("@one @two", "", False, True),
    ("@one@two", "", False, True),
    (" @one @two ", "", False, True),
    ("@one text", "text", False, False),
    ("@имя_2 @b", "", False, True),
    ("mail me@site.org now", "mail me.org now", False, False),
    ("@", "@", True, False),
    ("@ one", "@ one", False, False),
    ("@one!", "!", False, False),
    ("<b>bold</b> text", "bold text", False, False),
    ("<b\n>x", "<b >x", False, False),
    ("a < b and c > d", "a d", False, False),
    ("<<a>>", ">", False, False),
    ("<>", "", True, False),
    ("1 <2", "1 <2", False, False),
    ("see http://a.b/c?d=e f", "see f", False, False),
    ("see https://a.b f", "see f", False, False),
    ("http://", "http://", False, False),
    ("https:/a", "https:/a", False, False),
    ("www.a.b c", "c", False, False),
    ("www. a", "www. a", False, False),
    ("xhttp://y z", "x z", False, False),
    ("HTTP://a.b", "HTTP://a.b", False, False),
    ("a  b  c\nd", "a b c d", False, False),
    ("two\nlines\r\nthree", "two lines three", False, False),
    ("a\u200bb", "a\u200bb", False, False),
    ("a\u00a0b\u2003c", "a b c", False, False),
]


def is_word(c):
    return c == "_" or unicodedata.category(c)[0] in "LN"


def run_of(text, start, wanted):
    end = start
    while end < len(text) and wanted(text[end]):
        end += 1
    return end


def read_clean(text):
    """What is left when tags, mentions and links are stepped over, words one space apart."""
    out, k = [], 0
    while k < len(text):
        close = text.find(">", k)
        if text[k] == "<" and close > 0 and "\n" not in text[k:close]:
            k = close + 1
            continue
        if text[k] == "@" and run_of(text, k + 1, is_word) > k + 1:
            k = run_of(text, k + 1, is_word)
            continue
        for head in ("http://", "https://", "www."):
            end = run_of(text, k + len(head), lambda c: not c.isspace())
            if text.startswith(head, k) and end > k + len(head):
                k = end
                break
        else:
            out.append(text[k])
            k += 1
    return " ".join("".join(out).split())


def read_mentions(text):
    """Nothing but names after an @, perhaps with white space behind each."""
    text, k = text.strip(), 0
    while k < len(text) and text[k] == "@":
        end = run_of(text, k + 1, is_word)
        if end == k + 1:
            return False
        k = run_of(text, end, str.isspace)
    return bool(text) and k == len(text)


def read_squeezed(text):
    """Each run of white space as one space."""
    out = []
    for c in text:
        if not c.isspace():
            out.append(c)
        elif not out or out[-1] != " ":
            out.append(" ")
    return "".join(out)


def evaluate(spark, texts, **columns):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    out = df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()
    return {n: [r[n] for r in out] for n in columns}


def test_by_hand(spark):
    texts = [r[0] for r in BY_HAND]
    got = evaluate(
        spark, texts, clean=t.clean_text("s"), symbol=t.is_symbol_only("s"), mention=t.is_mention_only("s")
    )
    for k, (text, clean, symbol, mention) in enumerate(BY_HAND):
        assert (got["clean"][k], got["symbol"][k], got["mention"][k]) == (clean, symbol, mention), repr(text)
        assert read_clean(text) == clean and read_mentions(text) == mention, repr(text)


def test_ends_and_lengths(spark):
    texts = [None, "", " ", " x\u3000", "tail \n", "\n head", "abcdefghijkl", "abcdefghijklm", "абвгдежзийкл", "абвгдежзийклм"]
    got = evaluate(
        spark, texts, clean=t.clean_text("s"), strip=t.strip("s"), short=t.is_short("s"), blank=t.is_blank("s")
    )
    assert got["clean"][0] == "" and got["blank"] == [True] * 3 + [False] * 7
    assert got["strip"][1:] == ["", "", "x", "tail", "head", *texts[6:]]
    assert got["short"][1:] == [True] * 5 + [True, False, True, False]


PIECES = st.sampled_from(
    ["a", "Б", "é", " ", "\n", "\t", " ", " ", "<", ">", "@", "http://", "https://",
     "www.", "h", "w", ".", "_", "7", "!", "👍", " ", "\x1c", "/"]
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=40, max_size=40))
def test_random_texts(spark, texts):
    got = evaluate(
        spark, texts, clean=t.clean_text("s"), strip=t.strip("s"), symbol=t.is_symbol_only("s"),
        mention=t.is_mention_only("s"), squeeze=t.squeeze("s"),
    )
    assert got["clean"] == [read_clean(s) for s in texts]
    assert got["strip"] == [s.strip() for s in texts]
    assert got["squeeze"] == [read_squeezed(s) for s in texts]
    assert got["symbol"] == [not any(map(is_word, s)) for s in texts]
    assert got["mention"] == [read_mentions(s) for s in texts]


def test_every_white_space_character(spark):
    texts = [f"a{chr(n)}b" for n in range(1, 0x3100)]
    got = evaluate(spark, texts, squeeze=t.squeeze("s"))["squeeze"]
    assert got == [read_squeezed(s) for s in texts]


def test_long_mention_chain_does_not_overflow(spark):
    got = evaluate(
        spark, ["@name " * 50_000, "@name " * 50_000 + "!"], mention=t.is_mention_only("s")
    )
    assert got["mention"] == [True, False]


def test_digits(spark):
    texts = ["12", "0", "007", "", "1²", "٣", "-1", "1.5", " 3", "3\n", "99999999999999999999", None]
    got = evaluate(spark, texts, n=t.digits_or_zero("s"))["n"]
    assert got == [12, 0, 7, 0, 0, 0, 0, 0, 0, 0, 0, 0]


def test_label_at(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (2,), (3,), (None,)], "n int")
    got = [r[0] for r in df.select(t.label_at("n", ["neutral", "positive", "negative"])).collect()]
    assert got == [None, "neutral", "positive", "negative", None, None]


def test_lists(spark):
    df = spark.createDataFrame(
        [(["a ", " b"],), ([],), (["", "c"],), (None,)], "texts array<string>"
    )
    got = df.select(t.numbered_list("texts"), t.bulleted_block("texts", "none")).collect()
    assert [tuple(r) for r in got] == [
        ("1. a\n2. b", "- a\n\n- b"), ("", "none"), ("1. \n2. c", "- \n\n- c"), (None, "none"),
    ]


@pytest.mark.parametrize(
    "text, lead",
    [("One. Two! Three?", "One. Two!"), ("no end", "no end"), ("", ""), (None, ""),
     ("Wait... what? no", "Wait... what?"), ("A.\nB.\nC.", "A. B.")],
)
def test_first_sentences(spark, text, lead):
    assert evaluate(spark, [text], x=t.first_sentences("s"))["x"] == [lead]


def test_bind_uses_value(spark):
    got = evaluate(spark, ["ab"], x=t.bind(F.upper("s"), lambda v: F.concat(v, v)))
    assert got["x"] == ["ABAB"]
