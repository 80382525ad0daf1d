"""Benchmark decontamination: templates of word windows, hash-joined, with consistent slots."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodspark.llm.common import small_enough, stage, table

# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs hour hours day days week weeks month months year"
    " years minute minutes second seconds meter meters metre metres kilometer kilometers kilometre kilometres mile"
    " miles gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres percent dollar dollars"
    " euro euros cent cents usd eur gbp mph kmh degrees celsius fahrenheit"
).split()

# Words that are numbers.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    " eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()

#: A run of so many matched words holds an item, whatever share of it that is.
RUN = 13

#: In a text with more than one capitalised word in so many, capitals tell no names.
ONE_NAME_IN = 5

#: Bits of the table that tells which parts of windows the items have: at least, for each part, and at most.
BITS, BITS_A_PART, MOST_BITS = 1 << 20, 16, 1 << 22

# What a word is: as it stands, a number, a name inside a sentence, one at its start, a unit, a number word.
LITERAL, NUMBER, NAME, FIRST_NAME, UNIT, SPOKEN = range(6)

# in front of the first word of each sentence: a letter of a private-use area
_START = "\ue003"
_WORD_CHARS = rf"a-zA-Z0-9\p{{L}}\p{{M}}{_START}"
# a lone space between words is left as it is
_NOT_WORD = rf"(?! [{_WORD_CHARS}])[^{_WORD_CHARS}]+"
_MARKS_IN_NUMBER = r"(?<=[0-9])[.,](?=[0-9])"
_SENTENCE = r"(?:[.!?:]\s+|\n)[^a-zA-Z0-9\p{L}\p{M}]*"
_CAPITAL = r"\p{Lu}\p{Ll}"


def _texts(df: DataFrame, key: str) -> DataFrame:
    """key, words (in lower case), kinds (what each is), n and named (capitals tell names).

    The text is split once.  A text without words is one empty word, which no item has.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = F.when(text.rlike("[0-9][.,][0-9]"), F.regexp_replace(text, _MARKS_IN_NUMBER, "")).otherwise(text)
    spaced = F.regexp_replace(F.regexp_replace(joined, _SENTENCE, " " + _START), _NOT_WORD, " ")
    # nothing is filtered here: a filter would be moved below and compute its column once more
    rows = df.select(key, F.split(F.concat(F.lit(_START), F.btrim(spaced, F.lit(" " + _START))), " ").alias("raw"))
    plain = F.transform("raw", lambda w: F.lower(F.when(w.startswith(_START), F.substr(w, F.lit(2))).otherwise(w)))
    rows = rows.select(key, "raw", plain.alias("words"))

    def kind(word: Column, k: Column) -> Column:
        raw = F.get("raw", k)
        # most words are small letters and of no list
        return (
            F.when((raw == word) & (word >= ":") & ~word.isin(NUMBER_WORDS + UNITS), LITERAL)
            .when((word < ":") & (word >= "0"), NUMBER)
            .when(word.isin(NUMBER_WORDS), SPOKEN)
            .when(word.isin(UNITS) & _is_number(F.get("words", k - 1)), UNIT)
            .when(raw.rlike(rf"\A{_CAPITAL}"), NAME)
            .when(raw.rlike(rf"\A{_START}{_CAPITAL}"), FIRST_NAME)
            .otherwise(LITERAL)
        )

    rows = rows.select(key, "words", F.transform("words", kind).alias("kinds"))
    names = F.size(F.filter("kinds", lambda k: k == NAME))
    n = F.size("words")
    return rows.select(key, "words", "kinds", n.alias("n"), (names * ONE_NAME_IN <= n).alias("named"))


def _is_number(word: Column) -> Column:
    return ((word < ":") & (word >= "0")) | word.isin(NUMBER_WORDS)


#: Templates, by which kinds of words have placeholders: names inside sentences if capitals tell
#: names, or any capitalised word.
def _typed(template: str, kind: Column, named: bool) -> Column:
    told = {"inside": (kind == NAME) & F.lit(named), "any": (kind == NAME) | (kind == FIRST_NAME)}[template]
    return (kind == NUMBER) | (kind == SPOKEN) | (kind == UNIT) | told


FORMS = ("words", "inside", "any")


def _hashed(rows: DataFrame, *keep: str) -> DataFrame:
    """Adds the hashes of each form's words.  A word is hashed once; a placeholder has a constant hash of its kind."""
    rows = rows.select(*keep, "n", "kinds", "named", F.transform("words", lambda w: F.xxhash64(w)).alias("words_1"))
    for form in FORMS[1:]:
        constant = lambda k: F.when(k == FIRST_NAME, NAME).when(k == SPOKEN, NUMBER).otherwise(k).cast("long")
        typed = lambda named: F.zip_with(
            # most words are literal, which one comparison tells
            "words_1", "kinds", lambda h, k: F.when(k == LITERAL, h).when(_typed(form, k, named), constant(k)).otherwise(h)
        )
        # asked once a row, not for each word
        rows = rows.withColumn(f"{form}_1", F.when(F.col("named"), typed(True)).otherwise(typed(False)))
    return rows


def _run_at(form: str, size: int, k: Column) -> Column:
    """Hash of the run of `size` words that begins at a place."""
    words = [F.get(f"{form}_1", k + i) for i in range(size)]
    return words[0] if size == 1 else F.xxhash64(*words)


def _parts(width: int) -> list[tuple[int, int]]:
    """(size, place) of the runs that make a window: as many of four words as fit, then two, then one."""
    out, place = [], 0
    for size in (4, 2, 1):
        while width - place >= size:
            out.append((size, place))
            place += size
    return out


def _hash_at(form: str, width: int, k: Column) -> list[Column]:
    return [_run_at(form, size, k + place) for size, place in _parts(width)]


def _stride(width: int) -> int:
    """How many runs of the size of its first part a window has; of so many places in a row it holds one of each kind."""
    return width - _parts(width)[0][0] + 1


def _places(width: int, size: int | None = None, step: int = 1) -> Column:
    """Where a window, or a run of `size` words of one, may begin; none in texts shorter than the window."""
    nothing = F.array().cast("array<int>")
    places = F.sequence(F.lit(0), F.col("n") - (size or width), F.lit(step))
    return F.when(F.col("n") >= width, places).otherwise(nothing)


def _windows(form: str, width: int, places: Column) -> Column:
    """Array of (place, window, plain) of the windows at these places."""
    return F.transform(
        places,
        lambda k: F.struct(
            k.alias("place"), F.xxhash64(*_hash_at(form, width, k)).alias("window"), F.lit(form == "words").alias("plain")
        ),
    )


def _item_windows(items: DataFrame, width: int, widths: list[int]) -> DataFrame:
    """window, item_id, item_place, own, width, n_windows of all items, and the hashes of the parts and of
    all runs of the first part's size.

    Items shorter than `width` are one window.  Template windows count only if half of their words
    or more are no placeholders, in such short items only if they hold no number word, and templates
    of any capitalised word only where capitals tell names.
    """
    items = _hashed(items.withColumn("width", F.least("n", F.lit(width))), "item_id", "width").withColumn("n_windows", F.expr("n - width + 1"))
    out = None
    for w in widths:
        for form in FORMS:
            rows = items.where(F.col("width") == w)
            rows = rows.where("named") if form == "any" else rows
            rows = rows.select("*", F.explode(_places(w)).alias("k"))
            if form != "words":
                part = F.slice("kinds", F.col("k") + 1, w)
                held = lambda named: F.size(F.filter(part, lambda k: _typed(form, k, named)))
                held = F.when(F.col("named"), held(True)).otherwise(held(False))
                rows = rows.where((held > 0) & (held * 2 <= w))
                rows = rows if w == width else rows.where(~F.array_contains("kinds", SPOKEN))
            parts = _hash_at(form, w, F.col("k"))
            runs = [_run_at(form, _parts(w)[0][0], F.col("k") + place) for place in range(1, _stride(w))]
            found = rows.select(
                F.xxhash64(*parts).alias("window"), "item_id", F.col("k").alias("item_place"), F.lit(form == "words").alias("own"),
                "width", "n_windows", F.array(*parts, *runs).alias("parts"),
            )
            out = found if out is None else out.unionByName(found)
    return out.distinct()


def _table_of_parts(wanted: DataFrame) -> Column:
    """A table of bits, one set for the hash of every part and run of the items' windows; a constant.

    It has BITS_A_PART bits for each part, MOST_BITS at most (half a megabyte).  A part that is not
    in it is in no window; one that is in it may be, which the join finds out.
    """
    parts = wanted.select(F.explode("parts").alias("h")).distinct()
    n = parts.count()
    words = min(MOST_BITS, max(BITS, 1 << (n * BITS_A_PART).bit_length())) // 64
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 58).cast("int"))
    rows = parts.select(F.col("h").bitwiseAND(F.lit(words - 1)).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    table = [0] * words
    for row in rows.collect():  # a number for each word of the table at most
        table[row["at"]] = row["bits"]
    return F.from_json(F.lit(json.dumps(table)), "array<bigint>")


def _found(docs: DataFrame, widths: list[int], table: Column) -> DataFrame:
    """doc_id, place, window, plain of the documents' windows all of whose parts items have."""

    def windows(held: Column) -> Column:
        def known(h: Column) -> Column:
            at = F.get(held, h.bitwiseAND(F.size(table) - 1).cast("int"))
            return F.getbit(at, F.shiftrightunsigned(h, 58).cast("int")) == 1

        arrays = []
        for width in widths:
            size, step = _parts(width)[0][0], _stride(width)
            for form in FORMS:
                # a window holds one run that begins at a multiple of the step, so only those are looked up at first
                met = F.filter(_places(width, size, step), lambda j: known(_run_at(form, size, j)))
                begins = lambda j: F.sequence(F.greatest(j - (step - 1), F.lit(0)), F.least(j, F.col("n") - width))
                places = F.filter(F.flatten(F.transform(met, begins)), lambda k: F.forall(F.array(*_hash_at(form, width, k)), known))
                arrays.append(_windows(form, width, places))
        return F.concat(*arrays)

    # the table is a variable of all look-ups, so the plan and its tasks hold the constant once
    found = F.get(F.transform(F.array(table), windows), F.lit(0))
    found = _hashed(docs, "doc_id").select("doc_id", F.explode(found).alias("w"))
    return found.select("doc_id", "w.place", "w.window", "w.plain")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, percent: int = 50) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_slots: the benchmark items that documents hold.

    Texts become words in lower case; numbers, number words, units after them, and names become
    typed placeholders, in one template with names inside sentences only and in one with any
    capitalised word.  Where more than one word in ONE_NAME_IN inside sentences is capitalised (title case,
    German nouns), capitals tell no names.  Windows of `width` words (the whole item if it is shorter) of
    documents and items are joined by hash, as words and as templates, so a question with other
    numbers or names is found.  A template window of an item counts only if at least half of its
    words are no placeholders.  In an alignment of a document with an item, each value of the
    item's slots stands for one value in the document, the one that is there most often; template
    windows with another do not count, windows that match word for word always do.  An item is held
    if its windows match in at least `percent`, if windows word for word cover that share of its
    words, or if matched windows make a run of RUN words.

    Null and empty texts, items without words, and rows without an id match nothing.  Repeated items
    are reported under their own item_id, repeated rows of a document or item are one.  Extra columns
    are not read.  Parts of a document's windows are looked up in a table of bits before windows leave
    the document's row.  The windows of the items are broadcast only if they are few bytes; otherwise
    both sides are shuffled by window.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    prepared = stage(_texts(items, "item_id").where("words[0] <> ''").distinct(), "items")
    widths = sorted(r[0] for r in prepared.select(F.least("n", F.lit(width))).distinct().collect())  # at most `width` numbers
    if not widths:
        empty = "doc_id long, item_id long, n_windows int, n_matched long, n_slots long"
        return docs.sparkSession.createDataFrame([], empty)
    with_parts = stage(_item_windows(prepared, width, widths), "item-windows")
    wanted = small_enough(stage(with_parts.drop("parts"), "wanted"))
    found = _found(_texts(docs, "doc_id"), widths, _table_of_parts(with_parts)).join(wanted, "window")
    hits = found.select(
        "doc_id", "item_id", "n_windows", "width", "place", "item_place", (F.col("plain") & F.col("own")).alias("same")
    )
    hits = hits.groupBy("doc_id", "item_id", "n_windows", "width", "place", "item_place").agg(F.max("same").alias("same"))
    hits = stage(hits.withColumn("shift", F.col("place") - F.col("item_place")), "hits")

    # slots: only those of matched windows, and only the words at their places in the documents
    pairs = F.arrays_zip(F.col("words").alias("w"), F.col("kinds").alias("k"))
    slots = prepared.select("item_id", "named", F.posexplode(pairs).alias("p", "x"))
    kind = F.col("x.k")
    slots = slots.where(F.when(F.col("named"), _typed("any", kind, True)).otherwise(_typed("inside", kind, False)))
    slots = small_enough(stage(slots.select("item_id", "p", F.col("x.w").alias("value")).distinct(), "slots"))
    covered = hits.select(
        "doc_id", "item_id", "shift", "width", F.explode(F.sequence("item_place", F.col("item_place") + F.col("width") - 1)).alias("p")
    )
    covered = covered.join(slots, ["item_id", "p"]).distinct().withColumn("place", F.col("p") + F.col("shift"))
    covered = stage(covered, "covered")
    places = covered.groupBy("doc_id").agg(F.collect_set("place").alias("places"))  # no more than the document's words
    places = small_enough(stage(places, "places"))
    met = docs.join(places.drop("places"), "doc_id", "left_semi")
    told = _texts(met, "doc_id").select("doc_id", "words").join(places, "doc_id")
    there = told.select(
        "doc_id", F.explode(F.transform("places", lambda k: F.struct(k.alias("place"), F.get("words", k).alias("theirs")))).alias("x")
    ).select("doc_id", "x.*")
    values = covered.join(there.where("theirs IS NOT NULL"), ["doc_id", "place"])
    values = stage(values.select("doc_id", "item_id", "shift", "width", "value", "p", "theirs").distinct(), "values")
    # what stands for a value is what does so most often, of equals the first; other places are wrong
    alignment = ["doc_id", "item_id", "shift"]
    votes = values.groupBy(*alignment, "value", "theirs").agg(F.count("*").alias("c"), (-F.min("p")).alias("early"))
    ruling = votes.groupBy(*alignment, "value").agg(F.max(F.struct("c", "early", "theirs"))["theirs"].alias("ruling"))
    judged = stage(values.join(ruling, [*alignment, "value"]), "judged")
    slots = judged.where("theirs = ruling").groupBy(*alignment).agg(F.countDistinct("p").alias("slots"))
    wrong = judged.where("theirs <> ruling").select(
        *alignment, F.explode(F.sequence(F.col("p") - F.col("width") + 1, "p")).alias("item_place"), F.lit(True).alias("wrong")
    )
    good = hits.join(wrong.distinct(), [*alignment, "item_place"], "left").where("same OR wrong IS NULL")
    good = stage(good.join(slots, alignment, "left").drop("wrong"), "good")
    held = good.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"),
        F.countDistinct("item_place").alias("n_matched"),
        F.coalesce(F.max("slots"), F.lit(0)).alias("n_slots"),
        F.max("width").alias("width"),
    )
    # words of the item that windows cover word for word
    told = good.where("same").select(
        "doc_id", "item_id", F.explode(F.sequence("item_place", F.col("item_place") + F.col("width") - 1)).alias("p")
    ).groupBy("doc_id", "item_id").agg(F.countDistinct("p").alias("told"))
    # the longest run of windows one after the other
    runs = good.select(*alignment, "width", "item_place").distinct()
    start = F.col("item_place") - F.row_number().over(Window.partitionBy(*alignment).orderBy("item_place"))
    runs = runs.withColumn("start", start).groupBy(*alignment, "start", "width").agg(F.count("*").alias("c"))
    runs = runs.groupBy("doc_id", "item_id").agg(F.max(F.col("c") + F.col("width") - 1).alias("run"))
    judged = held.join(told, ["doc_id", "item_id"], "left").join(runs, ["doc_id", "item_id"], "left")
    return judged.where(
        (F.col("n_matched") * 100 >= F.col("n_windows") * percent)
        | (F.col("told") * 100 >= (F.col("n_windows") + F.col("width") - 1) * percent)
        | (F.col("run") >= RUN)
    ).select("doc_id", "item_id", "n_windows", "n_matched", "n_slots")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
