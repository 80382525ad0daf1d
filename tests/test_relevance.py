import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from moodspark.fixed_values import KEYWORDS
from moodspark.functions import relevance as r
from tests.conftest import rows

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def contains_any(text, keywords):
    return any(k.translate(UPPER) in text.translate(UPPER) for k in keywords)


CAPTIONS = [
    None, "", "nothing here", "TAX day", "syntaxis", "Узбекистан", "узбекистан", "УЗБЕКИСТАН",
    "в Ташкенте", "o'zbekiston", "o’zbekiston", "English", "100% fine_print", "цена", "Цена",
    "Korruptsiya", "İqtisod", "İNTERNET", "QONUN",
]


def test_default_keywords(spark):
    df = spark.createDataFrame(list(enumerate(CAPTIONS)), "i int, caption string")
    kept = {x[0] for x in rows(r.filter_relevant(df, "caption"))}
    assert kept == {
        i for i, c in enumerate(CAPTIONS) if c is None or contains_any(c, KEYWORDS)
    }
    assert 0 in kept and 1 not in kept and 4 in kept and 5 in kept and 6 not in kept
    counts = rows(r.relevance_counts(df, "caption"))
    assert counts == [(len(CAPTIONS), len(kept), len(CAPTIONS) - len(kept))]


WORDS = st.text(alphabet="aBkKiİßÜüЖж' %_", min_size=1, max_size=3)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(WORDS, min_size=1, max_size=5), st.lists(st.text(alphabet="aAbBkKKiIİßÜüЖж' %_", max_size=8), min_size=30, max_size=30))
def test_any_keywords(spark, keywords, captions):
    df = spark.createDataFrame(list(enumerate(captions)), "i int, caption string")
    kept = {x[0] for x in rows(r.filter_relevant(df, "caption", keywords))}
    assert kept == {i for i, c in enumerate(captions) if contains_any(c, keywords)}


def test_whole_words(spark):
    captions = ["a tax on", "syntax", "Tax!", "tax_rate", "НАЛОГ", "налоги", None, ""]
    df = spark.createDataFrame(list(enumerate(captions)), "i int, caption string")
    kept = rows(r.filter_relevant(df, "caption", ["tax", "налог"], mode="word").select("i"))
    assert [x[0] for x in kept] == [0, 2, 4, 6]


def test_needed_keywords_drop_only_longer_forms():
    assert r.needed_keywords(["Tax", "taxes", "syntax", "law"]) == ["law", "tax"]


def test_bad_arguments(spark):
    df = spark.createDataFrame([("x",)], "caption string")
    with pytest.raises(ValueError):
        r.filter_relevant(df, "caption", [])
    with pytest.raises(ValueError):
        r.filter_relevant(df, "caption", mode="fuzzy")
