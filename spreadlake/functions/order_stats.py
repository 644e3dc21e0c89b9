"""Order statistics of long sliding frames.

A segment's values are ranked once and laid out as a wavelet matrix: one bit
of every rank a level, with counts.  The k-th smallest value of any stretch
then takes one step a level, for all bars of the segment at once, so a bar
costs the logarithm of the segment's values whatever the frame's length, where
an array per bar is gathered and sorted anew.  The values are those of the
sorted arrays, bit for bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlake.series import PAIR, Frame

#: From this frame length on the tree is cheaper than arrays; both give the same values.
LONG = 100


class RankTree:
    """The k-th smallest value of any stretch of an array without missing values."""

    def __init__(self, values: np.ndarray):
        self.distinct, rank = np.unique(values, return_inverse=True)
        self.levels = []
        for bit in reversed(range(max(1, (len(self.distinct) - 1).bit_length()))):
            up = (rank >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~up)]).astype(np.int64)
            self.levels.append((bit, zeros))
            rank = np.concatenate([rank[~up], rank[up]])

    def kth(self, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """For each stretch ``begin <= i < end`` its value of rank ``k`` from 0, below the stretch's length."""
        code = np.zeros(len(k), dtype=np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[begin], zeros[end]
            low = k < b - a
            begin = np.where(low, a, zeros[-1] + begin - a)
            end = np.where(low, b, zeros[-1] + end - b)
            k = np.where(low, k, k - (b - a))
            code |= np.where(low, 0, 1 << bit)
        return self.distinct[code]

    def quantile(self, begin: np.ndarray, end: np.ndarray, p: float) -> np.ndarray:
        """The interpolated quantile, weighted as the engine's own percentile is."""
        at = (end - begin - 1) * p
        lo, hi = np.floor(at), np.ceil(at)
        a, b = self.kth(begin, end, lo.astype(np.int64)), self.kth(begin, end, hi.astype(np.int64))
        return np.where(a == b, a, (hi - at) * a + (at - lo) * b)

    def median(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - begin
        return (self.kth(begin, end, (n - 1) // 2) + self.kth(begin, end, n // 2)) / 2

    def nearest(self, begin: np.ndarray, end: np.ndarray, centre: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The distance of rank ``k`` from 0 among the distances of a stretch's values to its ``centre``.

        The ``k + 1`` nearest values stand together in sorted order.  Moving
        their stretch up, the distance below falls and the one above grows; a
        binary search finds where they cross.
        """
        below = lambda j: centre - self.kth(begin, end, j)
        above = lambda j: self.kth(begin, end, j + k) - centre
        first, last = np.zeros_like(k), end - begin - k - 1
        for _ in range(int(max(1, (last.max(initial=0) + 1).item().bit_length()))):
            mid = (first + last) // 2
            crossed = above(mid) >= below(mid)
            first, last = np.where(crossed | (first >= last), first, mid + 1), np.where(crossed, mid, last)
        before = np.maximum(first - 1, 0)
        return np.minimum(np.maximum(above(first), below(first)), np.maximum(above(before), below(before)))

    def spread(self, begin: np.ndarray, end: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Median distance to the centre."""
        n = end - begin
        return (self.nearest(begin, end, centre, (n - 1) // 2) + self.nearest(begin, end, centre, n // 2)) / 2


def _sliding(measure, col: str, n: int, least: int, f: Frame, outs: list[str]):
    def run(t: pa.Table) -> pa.Table:
        order = pc.sort_indices(t, sort_keys=[(o, "ascending") for o in f.order], null_placement="at_start").to_numpy()
        x = t[col].cast(pa.float64()).to_numpy(zero_copy_only=False)[order]
        known = ~t[col].is_null().to_numpy(zero_copy_only=False)[order]
        count = np.concatenate([[0], np.cumsum(known)]).astype(np.int64)
        begin, end = count[np.maximum(np.arange(len(x)) + 1 - n, 0)], count[1:]
        full = np.flatnonzero(end - begin >= max(1, least))
        results = measure(RankTree(x[known]), begin[full], end[full]) if len(full) else [np.zeros(0)] * len(outs)
        missing = np.ones(len(x), dtype=bool)
        missing[order[full]] = False
        for name, got in zip(outs, results, strict=True):
            value = np.zeros(len(x))
            value[order[full]] = got
            t = t.append_column(name, pa.array(value, pa.float64(), mask=missing))
        return t

    return run


def _applied(df: DataFrame, measure, col: str, n: int, least: int | None, f: Frame, outs: list[str]) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *[T.StructField(o, T.DoubleType()) for o in outs]])
    return df.groupBy(*f.keys).applyInArrow(_sliding(measure, col, n, n if least is None else least, f, outs), schema)


def with_quantiles(df: DataFrame, col: str, n: int, probs: dict[str, float], f: Frame = PAIR, least: int | None = None) -> DataFrame:
    """Interpolated quantiles of the known values among the last ``n`` rows, NULL below ``least`` (default ``n``) of them."""
    return _applied(df, lambda tree, a, b: [tree.quantile(a, b, p) for p in probs.values()], col, n, least, f, list(probs))


def with_median(df: DataFrame, col: str, n: int, out: str, f: Frame = PAIR, least: int | None = None) -> DataFrame:
    """Median of the known values among the last ``n`` rows, NULL below ``least`` (default ``n``) of them."""
    return _applied(df, lambda tree, a, b: [tree.median(a, b)], col, n, least, f, [out])


def with_median_and_spread(df: DataFrame, col: str, n: int, out: str, spread: str, f: Frame = PAIR) -> DataFrame:
    """Median of a full frame and the median distance to it."""

    def measure(tree: RankTree, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        centre = tree.median(a, b)
        return [centre, tree.spread(a, b, centre)]

    return _applied(df, measure, col, n, None, f, [out, spread])


def robust_score(x: Column, centre: Column, spread: Column) -> Column:
    return F.when(spread != 0, (x - centre) / (F.lit(1.4826) * spread + F.lit(1e-12)))
