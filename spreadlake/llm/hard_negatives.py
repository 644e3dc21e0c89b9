"""Hard negatives by Kronecker-packed products.

Integer components of several candidates are made non-negative by a bias and
laid into separate bit fields of one wide integer.  One multiplication of that
integer with an anchor's (biased) component multiplies all of them; summed over
the components no field can overflow into the next, so the fields hold exact
inner products, which unpack by shift and mask.  The wide integer is the 53-bit
significand of a double, where all products and sums stay exact and a matrix
product does the work; components too wide for that use integers of any width.

The anchors (a stated query set) meet all rows in blocks: a task sees at most
one block of anchors and one group of candidates, and returns the few best of
each anchor, which are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlake.llm.common import staged

#: Rows of a block of anchors and of a group of candidates that one task compares.
ANCHORS, CANDIDATES = 4096, 32_768
#: Scores held at once: candidates are packed and multiplied in strips of this many cells.
CELLS = 4_000_000
SCALE = 256.0
BITS = 53


def quantised(vectors: list[np.ndarray]) -> np.ndarray:
    """``floor(256 * x)`` of every component, as a matrix; short vectors are filled with zeros.

    The matrix holds int64 where all values are below 2**31, else Python integers.
    """
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        scaled = np.floor(out * SCALE)
    if not out.size or np.abs(scaled).max() < 2**31:
        return scaled.astype(np.int64)
    # beyond 2**60 a double is a whole number, and times 256 it may leave the range of doubles
    whole = [[int(x) * int(SCALE) if abs(x) > 2**60 else int(np.floor(x * SCALE)) for x in row] for row in out]
    return np.array(whole, dtype=object).reshape(out.shape)


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices, by packed multiplication."""
    width = max(anchors.shape[1], candidates.shape[1])
    a, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (anchors, candidates))
    if not a.size or not c.size:
        return np.zeros((len(a), len(c)), dtype=np.int64)
    bias_a, bias_c = int(np.abs(a).max()), int(np.abs(c).max())
    bits = max(1, (width * 4 * bias_a * bias_c).bit_length())
    fields = BITS // bits
    if not fields:
        a, c = a.astype(object), c.astype(object)
    # score = field - bias_a * sum(c) - bias_c * sum(a) - width * bias_a * bias_c
    fixed = bias_a * c.sum(axis=1)[None, :] + bias_c * a.sum(axis=1)[:, None] + width * bias_a * bias_c
    if not fields:
        return wide_products(a + bias_a, c + bias_c, bits) - fixed
    a, c = (a + bias_a).astype(np.float64), c + bias_c
    n = len(c)
    packed = np.zeros((-(-n // fields), width), dtype=np.int64)
    for k in range(fields):
        part = c[k::fields].astype(np.int64)
        packed[: len(part)] |= part << (bits * k)
    sums = (a @ packed.astype(np.float64).T).astype(np.int64)
    out = np.empty((len(a), n), dtype=np.int64)
    for k in range(fields):
        held = out[:, k::fields]
        held[...] = ((sums >> (bits * k)) & ((1 << bits) - 1))[:, : held.shape[1]]
    return out - fixed


def wide_products(a: np.ndarray, c: np.ndarray, bits: int) -> np.ndarray:
    """As the packed product, all candidates in one integer of any width per component."""
    packed = [sum(int(x) << (bits * k) for k, x in enumerate(column)) for column in c.T]
    mask = (1 << bits) - 1
    out = np.empty((len(a), len(c)), dtype=object)
    for i, row in enumerate(a):
        total = sum(int(x) * p for x, p in zip(row, packed))
        out[i] = [(total >> (bits * k)) & mask for k in range(len(c))]
    return out


def valid(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, vector, row, copies`` of the rows that take part; equal rows are one with their number.

    The label of a row whose id is divisible by 7 is moved on by one first.
    """
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    infinite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", infinite)
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    counted = given.filter(F.coalesce(sound, F.lit(False))).select("id", moved.alias("label"), "vector").groupBy("id", "label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    return counted.withColumn("row", F.xxhash64("id", "label", "vector"))


def blocks(rows: DataFrame, anchors: DataFrame, wanted: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``block`` and ``part``, so that every anchor meets every row in exactly one task.

    ``wanted`` copies of equal candidate rows are enough for a result of that many less one.
    """
    n_rows, n_anchors = rows.count(), anchors.count()
    n_blocks, n_parts = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // CANDIDATES))
    spread = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("block", spread(n_blocks, 1)).withColumn("part", every(n_parts))
    single = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least("copies", F.lit(wanted)).cast("int") - 1)))
    # new attributes: both sides of a cogroup come from the same table
    right = single.select(*[F.col(c).alias(c) for c in ("id", "label", "vector", "row", "copy")]).withColumn("part", spread(n_parts, 2)).withColumn("block", every(n_blocks))
    return left, right


def best(values: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` places of the highest values, equal ones in the order given."""
    if len(places) > 64 * n:  # no value below the n-th largest can be among them
        low = np.partition(values[places], len(places) - n)[len(places) - n]
        places = places[values[places] >= low]
    return places[np.argsort(-values[places], kind="stable")[:n]]


def strips(a: pd.DataFrame, c: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Candidates in order of id, strip by strip, with the scores of all anchors."""
    if not len(a) or not len(c):  # a group without rows on one side has no columns there
        return
    c = c.sort_values(["id", "row", "copy"], kind="stable").reset_index(drop=True)
    left, right = quantised(list(a["vector"])), quantised(list(c["vector"]))
    step = max(1, CELLS // max(1, len(a)))
    for at in range(0, len(c), step):
        yield c.iloc[at : at + step], products(left, right[at : at + step])


PARTIAL = "anchor long, anchor_row long, positive int, id long, score string"


def _partial(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["anchor", "anchor_row", "positive", "id", "score"])


def _positives(n: int):
    def task(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """The best rows of the anchor's own label, the anchor's own row left out once."""
        out: list[tuple] = []
        for part, scores in strips(a, c):
            ids, labels, rows, copies = (part[x].to_numpy() for x in ("id", "label", "row", "copy"))
            for i, (me, label, row) in enumerate(zip(a["id"], a["label"], a["row"])):
                own = (ids == me) & (rows == row) & (copies == 0)
                for k in best(scores[i], np.flatnonzero((labels == label) & ~own), n):
                    out.append((me, row, None, ids[k], str(scores[i, k])))
        return _partial(out)

    return task


def _negatives(n: int, low: int):
    def task(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """For each positive the best rows of other labels within its band of scores."""
        out: list[tuple] = []
        for part, scores in strips(a, c):
            ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
            for i, (me, label, row, wanted) in enumerate(zip(a["id"], a["label"], a["row"], a["positive_scores"])):
                others = np.flatnonzero(labels != label)
                theirs = scores[i, others]
                for k, score in enumerate(wanted):
                    top = int(score)
                    if top < 0:
                        continue  # the band is empty
                    inside = others[(theirs <= top) & (100 * theirs >= low * top)]
                    out.extend((me, row, k, ids[x], str(scores[i, x])) for x in best(scores[i], inside, n))
        return _partial(out)

    return task


def _compared(left: DataFrame, right: DataFrame, task) -> DataFrame:
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(lambda a, c: task(a, c), PARTIAL)
    # scores travel as text: they may be wider than 64 bits, and order as decimals of up to 38 digits
    return found.withColumn("value", F.col("score").cast("decimal(38,0)"))


def _first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("value").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor: Column | None = None,
    n_positives: int = 5,
    n_negatives: int = 5,
    low: int = 80,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows for which ``anchor`` (over the column ``id``; by default
    ids divisible by 100) holds.  An anchor's positives are its ``n_positives``
    best other rows of its label; for each, the ``n_negatives`` best rows of
    other labels that score at most as high and at least ``low`` per cent.
    Higher scores come first, equal ones by smaller id.

    Rows with a null id or label, a null vector, or a component that is null or
    not finite take no part.  Repeated rows are rows of their own: a repeated
    anchor gives its result as often, and a copy of an anchor is a positive.
    Vectors of different lengths compare as if filled with zeros; an empty
    vector scores 0.  Scores are exact; where components are so large that a
    score exceeds 38 digits the job fails rather than rank it wrongly, and one
    beyond 64 bits is returned as null.  Other columns are not looked at.  An
    empty table gives no rows.
    """
    rows = staged(valid(vectors, id_col, vector_col, label_col))
    anchors = rows.filter(F.col("id") % 100 == 0 if anchor is None else anchor)
    left, right = blocks(rows, anchors, max(n_positives, n_negatives) + 1)
    good = staged(_first(_compared(left, right, _positives(n_positives)), ["anchor", "anchor_row"], n_positives))
    listed = good.groupBy("anchor", "anchor_row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("listed"))
    known = left.join(listed.select(F.col("anchor").alias("id"), F.col("anchor_row").alias("row"), "listed"), ["id", "row"])
    known = known.withColumn("positive_scores", F.col("listed.score")).drop("listed")
    bad = _first(_compared(known, right, _negatives(n_negatives, low)), ["anchor", "anchor_row", "positive"], n_negatives)
    paired = bad.select("anchor", "anchor_row", (F.col("positive") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("value").alias("negative"))
    told = good.select("anchor", "anchor_row", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("value").alias("positive"))
    copies = anchors.select(F.col("id").alias("anchor"), F.col("row").alias("anchor_row"), "copies")
    done = paired.join(told, ["anchor", "anchor_row", "place"]).join(copies, ["anchor", "anchor_row"])
    done = done.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    small = lambda x: F.expr(f"try_cast({x} AS long)").alias(f"{x}_score")
    return done.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", small("positive"), small("negative"))
