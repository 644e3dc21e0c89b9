"""Quality rules: counts of each text, and how many documents of a host share its lines.

Only DataFrame expressions.  Words are runs without ASCII white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlake.llm.common import fresh
from spreadlake.llm.hosts import WHITE, frequent, line_key, lines, with_common

WINDOW = 8
SYMBOLS = r"[^#*$%&|<>]+"
#: A line (a long one) in more than this share of its host's documents, and in at least so many, is above the limit.
LIMIT, LONG_LIMIT, LEAST_DOCS = 0.02, 0.004, 3
#: A document that lost a line is depleted below this many words or this share of its words.
LEFT_WORDS, LEFT_SHARE = 20, 0.2
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WHITE}+", -1), lambda w: w != "")


def normal_key(line: Column) -> Column:
    """Hash of a line in lower case with digits as 0 and single spaces."""
    return line_key(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), f"{WHITE}+", " "))


def measured(docs: DataFrame, text: Column, prefix: str) -> DataFrame:
    """Add the five measures (names behind ``prefix``) and the array ``prefix + words``.

    The words of windows found twice are counted by positions: window hashes are
    sorted with their places, those equal to a neighbour are put in order of
    place, and each adds what it covers up to the next.  Texts without repeated
    windows stop at the count of distinct hashes.
    """
    p = lambda name: prefix + name
    whole = F.coalesce(text.cast("string"), F.lit(""))
    # Each array read inside a lambda is named more than once in its projection: an array named once
    # would be merged into the lambda by the optimizer and computed anew for every element.
    at = F.sequence(F.lit(1), F.size(p("hashes")) - (WINDOW - 1))
    out = (
        docs.withColumn(p("words"), words(whole))
        .withColumn(p("hashes"), F.transform(p("words"), lambda w: F.xxhash64(w)))
        .withColumn(p("windows"), F.when(F.size(p("hashes")) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.xxhash64(F.slice(p("hashes"), i, WINDOW)))))
        .withColumn(p("repeats"), F.size(F.array_distinct(p("windows"))) < F.size(p("windows")))
    )
    placed = F.sort_array(F.transform(p("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(p("sorted"), F.when(F.col(p("repeats")), placed))
    near = lambda i: F.get(F.col(p("sorted")), i)["h"]
    twice = F.filter(p("sorted"), lambda x, i: F.coalesce(near(i - 1) == x["h"], F.lit(False)) | F.coalesce(near(i + 1) == x["h"], F.lit(False)))
    out = out.withColumn(p("places"), F.sort_array(F.transform(twice, lambda x: x["i"])))
    reach = F.zip_with(p("places"), F.slice(p("places"), 2, F.greatest(F.size(p("places")), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    with_word = F.filter(lines(text), lambda x: x.rlike(f"[^{WHITE[1:]}"))
    return (
        out.withColumn(p("lines"), with_word)
        .withColumn(p("n_words"), F.size(p("words")).cast("long"))
        .withColumn(p("word_chars"), F.length(F.array_join(p("words"), "")).cast("long"))
        .withColumn(p("n_symbols"), F.length(F.regexp_replace(whole, SYMBOLS, "")).cast("long"))
        .withColumn(p("n_dup_lines"), (F.size(p("lines")) - F.size(F.array_distinct(p("lines")))).cast("long"))
        .withColumn(p("n_repeat_words"), F.when(F.col(p("repeats")), F.aggregate(reach, F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long"))
        .drop(*[p(x) for x in ("hashes", "windows", "repeats", "sorted", "places", "lines")])
    )


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", limit: float = LIMIT, least: int = LEAST_DOCS, long_limit: float = LONG_LIMIT) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``kept``, ``n_removed_lines`` and ``cleaned`` (existing columns of those names are replaced).

    ``cleaned`` is the text without the lines that more than ``limit`` of the
    host's documents share (long lines: ``long_limit``; at least ``least``).  ``kept`` is false if the
    base rules fail, and if such lines were removed and what is left is fewer
    than ``LEFT_WORDS`` words or less than ``LEFT_SHARE`` of the words.  A null
    text has no words and fails; its ``cleaned`` is null.  A null host is a
    host; each row is a document, repeated rows included.
    """
    added = [*MEASURES, "base_failed", "kept", "n_removed_lines", "cleaned"]
    base = docs.drop(*added)
    text, host = F.col(f"`{text_col}`"), F.col(f"`{host_col}`")
    common = frequent(base, host, F.transform(lines(text), normal_key), limit, long_limit, least)
    p = fresh(base, "rule_")
    while any(c.startswith(p) for c in base.columns):
        p += "_"
    out = measured(with_common(base, host, common, p + "common"), text, p)
    listed = lambda x: F.coalesce(F.array_contains(p + "common", normal_key(x)), F.lit(False))
    out = out.withColumn(p + "left", F.when(F.col(p + "common").isNotNull(), F.filter(lines(text), lambda x: ~listed(x))))
    removed = F.when(F.col(p + "left").isNotNull(), F.size(lines(text)) - F.size(p + "left")).otherwise(0)
    out = out.withColumn(p + "removed", removed).withColumn(p + "cleaned", F.when(F.col(p + "removed") == 0, text).otherwise(F.array_join(p + "left", "\n")))
    out = out.withColumn(p + "left_words", F.when(F.col(p + "removed") > 0, F.size(words(F.coalesce(F.col(p + "cleaned"), F.lit(""))))))
    n = F.col(p + "n_words")
    failed = (n < 20) | (100 * F.col(p + "n_repeat_words") > 30 * n)
    depleted = F.coalesce((F.col(p + "left_words") < LEFT_WORDS) | (F.col(p + "left_words") < LEFT_SHARE * n), F.lit(False))
    return out.select(
        *[F.col(f"`{c}`") for c in base.columns],
        *[F.col(p + m).alias(m) for m in MEASURES],
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        F.col(p + "removed").cast("long").alias("n_removed_lines"),
        F.col(p + "cleaned").alias("cleaned"),
    )
