"""Topic relevance of a caption."""

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.fixed_values import KEYWORDS
from moodspark.functions.text import WORD_CHARS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Case folding of A-Z only; other scripts stay as they are."""
    return F.translate(c, _UPPER, _UPPER.lower())


def _fold(word: str) -> str:
    return "".join(ch.lower() if ch in _UPPER else ch for ch in word)


def needed_keywords(keywords) -> list[str]:
    """Distinct keywords without those that contain another one: a text holding the longer
    word holds the shorter one too, so the answer is the same with fewer searches."""
    folded = sorted({_fold(k) for k in keywords}, key=lambda k: (len(k), k))
    kept: list[str] = []
    for word in folded:
        if not any(shorter in word for shorter in kept):
            kept.append(word)
    return kept


def _contains_folded(c: Column, keywords) -> Column:
    # one alternation of all keywords, for an automaton that reads a text once
    quoted = lambda ch: f"\\x{ord(ch):02x}" if ch.isascii() and not ch.isalnum() else ch
    pattern = "|".join("".join(map(quoted, word)) for word in needed_keywords(keywords))

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(pc.ascii_lower(texts), pattern)

    return found(c)


def mentions_any(c: Column, keywords=KEYWORDS, mode: str = "substring") -> Column:
    """Whether a text holds a keyword; null for null.

    Substrings are found by one automaton over Arrow batches, so the time does not grow with the
    number of keywords; whole words by a pattern of the engine's own.
    """
    if not keywords:
        raise ValueError("at least one keyword is needed")
    if mode == "substring":
        return _contains_folded(c, keywords)
    if mode == "word":
        words = "|".join(re.escape(k) for k in sorted(set(keywords)))
        return c.rlike(rf"(?iu)(?<![{WORD_CHARS}])(?:{words})(?![{WORD_CHARS}])")
    raise ValueError(f"unknown mode: {mode}")


def filter_relevant(
    df: DataFrame, caption: str, keywords=KEYWORDS, mode: str = "substring"
) -> DataFrame:
    """Keep rows whose caption names a topic.  Null captions are kept, empty ones are not."""
    c = F.col(caption)
    return df.where(c.isNull() | mentions_any(c, keywords, mode))


def relevance_counts(
    df: DataFrame, caption: str, keywords=KEYWORDS, mode: str = "substring"
) -> DataFrame:
    """One row: rows seen, kept and deleted, in a single pass."""
    c, keep = F.col(caption), F.col("keep")
    return df.select((c.isNull() | mentions_any(c, keywords, mode)).alias("keep")).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(keep).alias("kept_rows"),
        F.count_if(~keep).alias("deleted_rows"),
    )
