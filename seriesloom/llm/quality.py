"""Line-first quality rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPACE_PATTERN, WORD_PATTERN

# Fixed values of the base rules: symbol characters counted, fewest words, and largest share of repeated words in percent.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEATED = 50, 50

# Production settings of the line rules.
MAX_MARKS = 10  # percent of a line's characters that may be marks
MARKS = r"[^#*$%&|<>!~^=_{}\\]+"  # everything but marks
SENTENCE_MARKS = r"[.!?…:;,。！？、]"
UNPUNCTUATED = 200  # characters from which a line must hold a sentence mark
SEPARATOR = r" [|»›•·] "
MIN_SEPARATORS, MAX_ITEM = 3, 30  # separators of a navigation line, and its characters per item
SHORT_LINE = 300  # characters up to which phrases mark a whole line
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here to",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
)
MAX_LOST = 30  # percent of the word characters that may go with failing lines


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_PATTERN), "")


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(F.split(text, SPACE_PATTERN), ""))


def line_passes(line: Column) -> Column:
    """Whether a line stays. A line without a word always does."""
    size = F.length(line)
    marks = F.length(F.regexp_replace(line, MARKS, ""))
    punctuated = (marks * 100 <= size * MAX_MARKS) & ((size < UNPUNCTUATED) | line.rlike(SENTENCE_MARKS))
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    navigates = (separators >= MIN_SEPARATORS) & (size <= (separators + 1) * MAX_ITEM)
    small = F.lower(line)
    phrase = F.lit(False)
    for words in BOILERPLATE:
        phrase = phrase | small.contains(words)
    return ~line.rlike(WORD_PATTERN) | (punctuated & ~navigates & ~((size <= SHORT_LINE) & phrase))


def _repeated_words(words: Column, seen: Column) -> Column:
    """Positions covered by three-word windows that occur twice, from sorted windows. ``seen``: whether any does."""
    spots = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(
        spots, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))
    )
    return F.when(seen, F.array_sort(windows))


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``row`` (all columns of ``docs``), the measures, ``base_failed``, ``kept`` and ``cleaned`` (the text that stays).

    Rules are tried on each line with a word: too many marks, or a long line without a
    sentence mark; a row of short items between separators; a short line with a phrase
    of a web page's furniture. Failing lines go. A document is kept unless it fails the
    base rules (fewer than 50 words, or more than half of them in repeated three-word
    windows) or loses more than MAX_LOST percent of its word characters.

    A null text counts as empty: no words, base rules failed, not kept. Repeated rows,
    null keys and columns of any name stay as they are. An empty table gives an empty one.
    """
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("lines", F.split("text", "\n"))
    words = F.col("words")
    spots = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(spots, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    rows = rows.withColumn("hashes", F.when(F.size(words) > 3, hashes))
    # Different windows nearly always differ in the hash, and equal ones never do: only texts with
    # an equal pair of hashes sort their windows, which settles the matter by the words themselves.
    rows = rows.withColumn("seen", F.coalesce(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.lit(False)))
    rows = rows.withColumn("sorted", _repeated_words(words, F.col("seen"))).drop("hashes", "seen")
    twins = F.zip_with(
        F.col("sorted"), F.slice("sorted", 2, F.size("sorted")), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"]))
    )
    rows = rows.withColumn("spots", F.array_sort(F.array_distinct(F.flatten(F.array_compact(twins))))).drop("sorted")
    covered = F.zip_with(
        F.col("spots"), F.slice("spots", 2, F.size("spots")), lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3))
    )
    filled = F.filter("lines", lambda line: line.rlike(WORD_PATTERN))
    rows = (
        rows.withColumn("filled", filled)
        .withColumn("cleaned", F.array_join(F.filter("lines", line_passes), "\n"))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("text", F.lit(SYMBOLS)).cast("long"))
    )
    rows = rows.withColumn("n_dup_lines", (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    stays = word_chars(F.col("cleaned"))
    lost = (F.col("word_chars") - stays) * 100 > F.col("word_chars") * MAX_LOST
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~lost)


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the measures, ``base_failed`` and ``kept`` of every document; see ``assess``."""
    found = assess(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return found.select(
        F.col("row.key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_clean(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """The documents ``assess`` keeps, without their failing lines; ``size`` (if there is such a column) is their new length."""
    # The partition number keeps the optimizer from moving the filter below the projections, where
    # it would repeat their arrays inside each other's loops.
    kept = assess(docs, text).withColumn("part", F.spark_partition_id()).where("kept and part >= 0")
    return kept.select(*[_renewed(F.col("row").getField(c), c, text, size).alias(c) for c in docs.columns])


def _renewed(old: Column, name: str, text: str, size: str | None) -> Column:
    if name == text:
        return F.col("cleaned")
    if name == size:
        # Only where lines went: a size that was null or counted otherwise stays with an unchanged text.
        return F.when(F.col("cleaned") == F.col("text"), old).otherwise(F.length("cleaned"))
    return old
