"""Lines by host: how many documents of a host hold a line, as DataFrame expressions.

Lines are compared by a 64-bit hash.  Counting is one aggregation on (host,
line) with partial sums before the shuffle, so a host or a line that holds a
third of all rows is no single task.  Only lines above a *ratio* of a host's
documents are kept, which bounds the list of a host: with at most ``m`` lines a
document on average and ratio ``r`` it has at most ``m / r`` entries.  Long lines
have a ratio of their own: that a passage comes back is no accident.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlake.llm.common import staged

WHITE = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
#: Characters of a long line, about 35 to 50 words.
LONG = 200


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Hash of a line without white space at its ends; the lowest bit tells long lines."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.length(bare) >= LONG, F.xxhash64(bare).bitwiseOR(F.lit(1))).otherwise(F.xxhash64(bare).bitwiseAND(F.lit(-2)))


def distinct_keys(keys: Column) -> Column:
    """Each key once, without that of lines that hold no word."""
    return F.array_remove(F.array_distinct(keys), line_key(F.lit("")))


def frequent(docs: DataFrame, host: Column, keys: Column, ratio: float, long_ratio: float, least: int) -> DataFrame:
    """``host`` and ``common``: the line keys in more than ``ratio`` of the host's documents and in at least ``least``.

    For long lines ``long_ratio`` counts.

    Each row of ``docs`` is a document and counts a line once.  A null host is a
    host of its own.  The result is a staged table with one row per host that
    has such lines.
    """
    seen = docs.select(host.alias("host"), distinct_keys(keys).alias("keys"))
    total = seen.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counted = seen.select("host", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    over = counted.alias("c").join(total.alias("t"), F.expr("c.host <=> t.host")).filter(F.col("c.n") > F.when(F.col("c.line").bitwiseAND(F.lit(1)) == 1, long_ratio).otherwise(ratio) * F.col("t.total"))
    return staged(over.groupBy(F.col("c.host").alias("host")).agg(F.collect_set("c.line").alias("common")))


def with_common(docs: DataFrame, host: Column, common: DataFrame, name: str) -> DataFrame:
    """``docs`` with the list of its host as column ``name`` (null where the host has none).

    The staged list's true size decides between a broadcast and a shuffled join,
    whose skewed hosts adaptive execution splits.
    """
    found = common.select(F.col("host").alias(f"{name}_host"), F.col("common").alias(name))
    return docs.join(found, host.eqNullSafe(F.col(f"{name}_host")), "left").drop(f"{name}_host")
