"""Quality rules: counts of words, symbols, repeated lines and windows, and divergence from a language's histograms.

DataFrame functions only. A text's shares of character classes, and of its language's most common words, are compared
with the shares over all texts of that language by the Jensen-Shannon distance (the square root of the divergence, in
bits). Short texts say too little for that; guards keep them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profspark.llm.scratch import Scratch, narrowed, packed, unpacked

WORD = r"[^\x20\x09-\x0D]+"
#: Character classes as what they leave out; `other` is the rest of a text.
CLASSES = {
    "lower": "[^a-z]+",
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "space": r"[^\x20\x09-\x0D]+",
    "mark": r"[^.,;:!?'\"()\-]+",
    "beyond": r"[\x00-\x7F]+",
}
COMMON = {
    "en": "the of and to in a is that for it as was with on by this",
    "de": "der die und in den von zu das mit sich des auf für ist im dem",
    "fr": "de la le et les des en un du une que est pour qui dans a",
    "es": "de la que el en y a los se del las un por con no una",
}
TRIMMED = ".,;:!?'\"()"
#: The Jensen-Shannon distances that a text may have, and from how many characters or words on they count.
MOST_CHARS, MOST_WORDS = 0.35, 0.6
LEAST_CHARS, LEAST_WORDS = 200, 50
FEWEST_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def _left(text: Column, pattern: str) -> Column:
    """How many characters stay without what the pattern matches."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def repeat_words(w: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words that occur twice or more; windows are equal when 64-bit hashes of them are."""
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(size)]))

    def covered(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["x"] == x["x"]) | (F.get(s, j + 1)["x"] == x["x"]))
        places = let(ordered, lambda s: F.array_sort(F.transform(same(s), lambda x: x["i"])))
        gaps = let(places, lambda p: F.transform(p, lambda i, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - i, F.lit(size)))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))
    return F.when(F.size(w) < size, 0).otherwise(counted).cast("long")


def _common(w: Column, lang: Column) -> Column:
    """How often each of the language's common words occurs; null for languages without a list."""
    out = F.lit(None).cast("array<bigint>")
    for name, listed in COMMON.items():
        own = listed.split()
        found = F.filter(F.transform(w, lambda x: F.lower(F.btrim(x, F.lit(TRIMMED)))), lambda x: x.isin(own))  # noqa: B023
        counts = let(found, lambda f: F.transform(F.array(*map(F.lit, own)), lambda c: F.size(F.filter(f, lambda x: x == c)).cast("long")))  # noqa: B023
        out = F.when(lang == name, counts).otherwise(out)
    return out


def _distance(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts, 0 where one of them is empty or missing."""

    def total(h: Column) -> Column:
        return F.aggregate(h, F.lit(0.0), lambda a, x: a + x)

    def terms(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (part(p) + part(q)) / 2

    n, m = total(own), total(reference)
    each = F.zip_with(own, reference, lambda a, b: terms(a / n, b / m))
    return F.coalesce(F.when((n > 0) & (m > 0), F.sqrt(F.greatest(total(each), F.lit(0.0)))), F.lit(0.0))


def assessed(df: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with the five COUNTS, char_distance, word_distance, base_failed and kept.

    Those replace columns of the same names. Words are runs without ASCII white space. n_dup_lines: lines with a word
    that equal an earlier line of the text. base_failed: under 10 words, or over 20 per cent of them in repeated
    windows. kept: not base_failed, and both distances within bounds, or the text too short for them. The references are
    sums over all rows of a language; rows of a null language are compared with all rows. Languages without a list of
    common words have word_distance 0. Null texts count as empty. Repeated rows count each time.
    """
    scratch = Scratch(df.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = narrowed(packed(df, text=F.col(text_col), lang=F.col(lang_col).cast("string")), keep)
    rows = rows.select("row", "lang", text.alias("text")).select("row", "lang", "text", words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    classes = [_left(F.col("text"), p) for p in CLASSES.values()]
    measured = rows.select(
        "row",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length("text").cast("long").alias("n_chars"),
        _left(F.col("text"), r"[\x20\x09-\x0D]+").alias("word_chars"),
        _left(F.col("text"), "[^#*$%&|<>]+").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.array(*classes).alias("classes"),
        _common(F.col("w"), F.col("lang")).alias("common"),
    )
    kept = scratch.keep(measured)

    def whole(counts: str, size: str) -> Column:
        """Counts, and what is left of the text as a last one."""
        return F.concat(F.col(counts), F.array(F.col(size) - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x))).cast("array<double>")

    counted = kept.withColumn("chars", whole("classes", "n_chars")).withColumn("words", whole("common", "n_words"))
    width = len(CLASSES) + 1
    most = max(len(x.split()) for x in COMMON.values()) + 1
    sums = [F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0.0)) for i in range(n)]).alias(f"all_{c}") for c, n in (("chars", width), ("words", most))]
    # One row per language, and one for all rows. Written, so that its size decides how it is joined.
    by_lang = scratch.keep(counted.groupBy("lang").agg(*sums))
    total = by_lang.agg(F.array(*[F.sum(F.get("all_chars", F.lit(i))) for i in range(width)]).alias("every_chars"))
    both = counted.join(by_lang.where("lang is not null"), "lang", "left").join(F.broadcast(total))
    found = both.withColumn("char_distance", _distance(F.col("chars"), F.coalesce("all_chars", "every_chars")))
    found = found.withColumn("word_distance", _distance(F.col("words"), F.slice("all_words", 1, F.greatest(F.size("words"), F.lit(0)))))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    near = ((F.col("n_chars") < LEAST_CHARS) | (F.col("char_distance") <= MOST_CHARS)) & ((F.col("n_words") < LEAST_WORDS) | (F.col("word_distance") <= MOST_WORDS))
    found = found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & near)
    return unpacked(found, *COUNTS, "char_distance", "word_distance", "base_failed", "kept")
