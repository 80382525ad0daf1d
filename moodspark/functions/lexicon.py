"""Default scorer: sum of word weights, read from a small dictionary.

Row-local by design.  The text is tokenised and summed where it lies, so labelling
needs no shuffle however large the table is or however often a text repeats.
"""

from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodspark.fixed_values import DEFAULT_LABEL
from moodspark.functions.text import WORD_CHARS

MAX_LEXICON_WORDS = 20_000  # the words travel inside the plan

DEFAULT_LEXICON = {
    # English
    "good": 1, "great": 1, "happy": 1, "love": 1, "thanks": 1, "excellent": 1, "best": 1,
    "bad": -1, "awful": -1, "sad": -1, "hate": -1, "terrible": -1, "worst": -1, "shame": -1,
    # Russian
    "хорошо": 1, "отлично": 1, "спасибо": 1, "молодцы": 1, "рад": 1, "здорово": 1, "люблю": 1,
    "плохо": -1, "ужас": -1, "печально": -1, "жаль": -1, "позор": -1, "кошмар": -1, "грустно": -1,
    # Uzbek
    "yaxshi": 1, "rahmat": 1, "zo'r": 1, "ajoyib": 1,
    "yomon": -1, "afsus": -1, "uyat": -1, "dahshat": -1,
}


def lexicon_score(c: Column, lexicon: Mapping[str, float] = DEFAULT_LEXICON) -> Column:
    if not lexicon:
        raise ValueError("the lexicon is empty")
    if len(lexicon) > MAX_LEXICON_WORDS:
        raise ValueError(
            f"{len(lexicon)} words exceed {MAX_LEXICON_WORDS}; use score_lexicon_table"
        )
    by_weight: dict[float, list[str]] = defaultdict(list)
    for word, weight in lexicon.items():
        by_weight[weight].append(word.lower())
    # an apostrophe between letters is part of the word only if the lexicon uses it
    inner = "(?:'[%s]+)*" % WORD_CHARS if any("'" in w for w in lexicon) else ""
    tokens = F.regexp_extract_all(
        F.lower(F.coalesce(c, F.lit(""))), F.lit(f"[{WORD_CHARS}]+{inner}"), F.lit(0)
    )

    # whole weights add up as whole numbers, others as doubles
    nothing = F.lit(0) if all(isinstance(w, int) for w in by_weight) else F.lit(0.0)

    def weight_of(token: Column) -> Column:
        value = nothing
        for weight, words in by_weight.items():
            value = F.when(token.isin(words), F.lit(weight) + nothing).otherwise(value)
        return value

    return F.aggregate(tokens, nothing, lambda total, token: total + weight_of(token))


def lexicon_label(c: Column, lexicon: Mapping[str, float] = DEFAULT_LEXICON) -> Column:
    score = lexicon_score(c, lexicon)
    # signum keeps the aggregate in the plan once; a score tested twice would run twice
    sign = F.signum(score).cast("int")
    return F.element_at(
        F.array(F.lit("negative"), F.lit(DEFAULT_LABEL), F.lit("positive")), sign + 2
    )
