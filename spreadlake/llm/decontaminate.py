"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive hashes of ``GRAM`` words the smallest is kept
(the last of equals).  Two texts that share ``GRAM + WINDOW - 1`` = 13 words in a
row therefore share a fingerprint inside them.  Fingerprints of documents and
benchmark items are joined by hash, and each hit is extended word by word to the
13-word windows around it, so every window of an item that stands in a document
is found and nothing else.  Items of fewer than 13 words are one window of their
own length, looked for with rolling hashes of that length.

A bitmap of fixed size over the benchmark's hashes drops most fingerprints of
documents before the shuffle; it has no false negatives, and the join decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlake.llm.common import ALNUM, fresh, staged, text_bytes, words_of

SPAN, GRAM = 13, 8
WINDOW = SPAN - GRAM + 1
#: Words kept before and behind a fingerprint: as far as a 13-word window around it reaches.
MARGIN = SPAN - GRAM
CONTEXT = GRAM + 2 * MARGIN
#: Bits of the bitmap (2 MB), whatever the benchmark's size.
BITS = 24
_ODD = np.random.default_rng(13).integers(1, 2**63, SPAN, dtype=np.uint64) | np.uint64(1)
HITS = "array<struct<size:int,hash:bigint,pos:int,context:array<bigint>>>"


def word_hashes(text: bytes) -> np.ndarray:
    words = words_of(text, ALNUM)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _ODD[0]
    for k in range(1, size):
        out += h[k : n + k] * _ODD[k]
    return (out ^ (out >> np.uint64(31))) * _ODD[1]


def winnow(grams: np.ndarray) -> np.ndarray:
    """Places of the kept hashes: the smallest of each window, the last of equals."""
    if not len(grams):
        return np.zeros(0, np.int64)
    width = min(WINDOW, len(grams))
    back = np.lib.stride_tricks.sliding_window_view(grams, width)[:, ::-1]
    return np.unique(np.arange(len(back)) + width - 1 - back.argmin(1))


def prints(h: np.ndarray, short: tuple[int, ...], outside: int, whole_if_short: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, hashes, places) of the fingerprints: winnowed ones, then runs of each short length."""
    if len(h) >= SPAN:
        grams = rolling(h, GRAM)
        at = winnow(grams)
        yield GRAM, grams[at], at
    for size in (len(h),) if whole_if_short and 0 < len(h) < SPAN else short:
        runs = rolling(h, size) + np.uint64(size)
        yield -size, runs, np.arange(len(runs))


def around(h: np.ndarray, at: int, outside: int) -> list[int]:
    """The words from ``MARGIN`` before a fingerprint to ``MARGIN`` behind it; ``outside`` where there is none."""
    out = [outside] * CONTEXT
    first = max(0, at - MARGIN)
    got = h[first : at + GRAM + MARGIN].astype(np.int64).tolist()
    out[first - at + MARGIN : first - at + MARGIN + len(got)] = got
    return out


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, size, hash, context``: one row per fingerprint of each item (size negative: a short item whole)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item"], pdf["raw"], strict=True):
                h = word_hashes(text)
                for size, hashes, at in prints(h, (), 0, True):
                    rows += [(item, size, int(x), around(h, int(p), 1) if size > 0 else []) for x, p in zip(hashes.astype(np.int64), at, strict=True)]
            yield pd.DataFrame(rows, columns=["item", "size", "hash", "context"])

    picked = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), text_bytes(f"`{text_col}`").alias("raw"))
    return picked.mapInPandas(run, "item string, size int, hash bigint, context array<bigint>")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key`` (its id), ``print`` (hash of its text), ``n_words``, ``windows`` and ``items``.

    ``windows`` lists (first word, words) of every place where an item's window
    stands, ``items`` the ids of those items as strings.  Rows are told apart by
    id and text, so rows without id or with a repeated id get their own result.
    Null texts have no words.  An item without id finds windows but is not listed.
    """
    fingerprints = staged(items_of(benchmark, item_col, item_text_col))
    short = tuple(sorted(-r["size"] for r in fingerprints.filter("size < 0").select("size").distinct().collect()))  # at most 12
    bits = fingerprints.select(F.pmod("hash", F.lit(1 << BITS)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).toPandas()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[bits["at"].to_numpy(np.int64)] = bits["set"].to_numpy(np.int64)
    bitmap = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, low, mask = bitmap.value, np.uint64(63), np.uint64((1 << BITS) - 1)
        for pdf in batches:
            rows = []
            for key, mark, text in zip(pdf["key"], pdf["print"], pdf["raw"], strict=True):
                h = word_hashes(text)
                found = []
                for size, hashes, at in prints(h, short, 0, False):
                    bit = hashes & mask
                    likely = np.flatnonzero(known[(bit >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (bit & low) & np.uint64(1))
                    found += [{"size": size, "hash": int(hashes[i : i + 1].view(np.int64)[0]), "pos": int(at[i]), "context": around(h, int(at[i]), 0) if size > 0 else []} for i in likely]
                rows.append((key, mark, len(h), found))
            yield pd.DataFrame(rows, columns=["key", "print", "n_words", "hits"])

    picked = docs.select(F.col(f"`{id_col}`").alias("key"), text_bytes(f"`{text_col}`").alias("raw"))
    picked = picked.withColumn("print", F.xxhash64("raw"))
    kind = docs.schema[id_col].dataType.simpleString()
    seen = staged(picked.mapInPandas(run, f"key {kind}, print bigint, n_words long, hits {HITS}"))
    hit = seen.filter(F.size("hits") > 0).select("key", "print", F.explode("hits").alias("h")).select("key", "print", "h.*")
    theirs = fingerprints.groupBy("size", "hash", "context").agg(F.collect_set("item").alias("with_it")).withColumnRenamed("context", "item_context")
    joined = hit.join(theirs, ["size", "hash"])
    same = F.filter(F.sequence(F.lit(1), F.lit(MARGIN + 1)), lambda s: F.slice("context", s, SPAN) == F.slice("item_context", s, SPAN))
    extended = F.when(F.col("size") > 0, F.transform(same, lambda s: F.struct((F.col("pos") - MARGIN + s - 1).alias("first"), F.lit(SPAN).alias("words"))))
    extended = extended.otherwise(F.array(F.struct(F.col("pos").alias("first"), (-F.col("size")).alias("words"))))
    stands = joined.select("key", "print", F.explode(extended).alias("window"), "with_it")
    per_doc = stands.groupBy("key", "print").agg(F.sort_array(F.collect_set("window")).alias("windows"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("with_it")))).alias("items"))
    out = seen.alias("d").join(per_doc.alias("h"), F.expr("d.key <=> h.key AND d.print = h.print"), "left")
    return out.select("d.key", "d.print", "n_words", F.coalesce("windows", F.array().cast("array<struct<first:int,words:int>>")).alias("windows"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def verdicts(found: DataFrame) -> DataFrame:
    """Add ``n_hit``, the words inside any window, and ``contaminated``: hit, and at least a twentieth of the words are."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))
    end = lambda w: w["first"] + w["words"]
    covered = F.aggregate("windows", start, lambda acc, w: F.struct(
        F.greatest(acc["reach"], end(w)).alias("reach"),
        (acc["n"] + F.greatest(F.lit(0), end(w) - F.greatest(acc["reach"], w["first"]))).alias("n"),
    ), lambda acc: acc["n"].cast("long"))
    return found.withColumn("n_hit", covered).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    key, mark = fresh(docs, "bad_key"), fresh(docs, "bad_print")
    bad = verdicts(hits(docs, benchmark, id_col, text_col)).filter("contaminated").select(F.col("key").alias(key), F.col("print").alias(mark)).distinct()
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.xxhash64(text_bytes(f"`{text_col}`")) == F.col(mark)), "left_anti")
