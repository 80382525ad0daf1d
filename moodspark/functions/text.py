"""Text cleaning, predicates and list formatting.

Word characters and white space are spelled out as classes, because the engine's
own shorthands are ASCII-only (``\\s``) or count combining marks as letters.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodspark.fixed_values import SHORT_TEXT_CHARS

# --- fixed values: character classes and the removal pattern ------------------
WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
REMOVED_PARTS = (
    rf"<[^\n>]*>|@[{WORD_CHARS}]+|https?://[^{SPACE_CHARS}]+|www\.[^{SPACE_CHARS}]+"
)

# The same white space, phrased so that letters are turned away by two comparisons: these
# classes are tested on every character, and a plain union of ranges takes three times as long.
_LATIN_SPACE = r"\t\n\x{0b}\f\r\x{1c}\x{1d}\x{1e}\x{1f}\x{85}\x{a0}"
_OTHER_SPACE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = rf"[\x00-\x20\x7f-\x{{3000}}&&[ {_LATIN_SPACE}{_OTHER_SPACE}]]"
SPACE_NOT_BLANK = rf"[\x00-\x1f\x7f-\x{{3000}}&&[{_LATIN_SPACE}{_OTHER_SPACE}]]"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column | str) -> Column:
    """Remove white space (any Unicode kind) from both ends."""
    # one greedy run to the end and a short step back; a pattern for trailing white space
    # would be tried at every space of the text
    return F.regexp_extract(_column(c), rf"(?s)\A{SPACE}*+(.*[^{SPACE_CHARS}])", 1)


def squeeze(c: Column | str) -> Column:
    """Every run of white space becomes one space.  Lone spaces are not touched."""
    return F.regexp_replace(_column(c), rf"{SPACE_NOT_BLANK}{SPACE}*| {SPACE}+", " ")


def clean_text(c: Column | str) -> Column:
    """Drop tags, mentions and URLs, squeeze white space; null becomes ''."""
    c = F.coalesce(_column(c), F.lit(""))
    # most texts hold nothing to remove, which four byte searches find out
    suspect = c.contains("<") | c.contains("@") | c.contains("http") | c.contains("www.")
    kept = F.when(
        suspect, F.regexp_replace(c, rf"(?=[<@hw])(?:{REMOVED_PARTS})", "")
    ).otherwise(c)
    # all white space is plain spaces after the squeeze, so trim() is enough
    return F.trim(squeeze(kept))


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space only.  Stops at the first visible character."""
    c = _column(c)
    return c.isNull() | ~c.rlike(rf"[^{SPACE_CHARS}]")


def is_symbol_only(c: Column | str) -> Column:
    """No letter, digit or underscore anywhere (also true for '')."""
    return ~_column(c).rlike(rf"[{WORD_CHARS}]")


def is_short(c: Column | str, limit: int = SHORT_TEXT_CHARS) -> Column:
    """At most ``limit`` code points, counted before trimming."""
    return F.char_length(_column(c)) <= limit


def is_mention_only(c: Column | str) -> Column:
    """Nothing but mentions.  Possessive, so long mention chains neither backtrack nor recurse."""
    return _column(c).rlike(
        rf"\A[{SPACE_CHARS}]*+(?:@[{WORD_CHARS}]++[{SPACE_CHARS}]*+)++\z"
    )


def is_noise(c: Column | str) -> Column:
    return is_short(c) | is_symbol_only(c) | is_mention_only(c)


def digits_or_zero(c: Column | str) -> Column:
    """ASCII digits as a number, anything else 0."""
    c = _column(c)
    return F.when(
        c.rlike(r"\A[0-9]+\z"), F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))
    ).otherwise(F.lit(0).cast("bigint"))


def label_at(index: Column | str, labels: tuple[str, ...] | list[str]) -> Column:
    """Class index -> label; the scorer names its own order.  Out of range gives null."""
    index = _column(index)
    return reduce(
        lambda acc, pair: acc.when(index == pair[0], F.lit(pair[1])),
        list(enumerate(labels))[1:],
        F.when(index == 0, F.lit(labels[0])),
    )


def numbered_list(texts: Column | str) -> Column:
    """Array of text -> '1. first\\n2. second'."""
    return F.array_join(
        F.transform(
            _column(texts),
            lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), strip(t)),
        ),
        "\n",
    )


def bulleted_block(texts: Column | str, empty_text: str) -> Column:
    """Array of text -> '- first\\n\\n- second', or ``empty_text`` when there is none."""
    texts = _column(texts)
    block = F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), strip(t))), "\n\n")
    return F.when(F.coalesce(F.size(texts), F.lit(0)) <= 0, F.lit(empty_text)).otherwise(block)


def first_sentences(c: Column | str, count: int = 2) -> Column:
    """The leading sentences of a cleaned text; all of it when no sentence ends."""
    ends = rf"\A(?:[^.!?]*[.!?]+ ?){{1,{count}}}"

    def head(cleaned: Column) -> Column:
        # of a text without an end of sentence the extract is ''
        lead = F.regexp_extract(cleaned, ends, 0)
        return F.trim(F.coalesce(F.nullif(lead, F.lit("")), cleaned))

    # never null, and known to be so: a later "is not null" costs nothing
    return F.coalesce(bind(clean_text(c), head), F.lit(""))
