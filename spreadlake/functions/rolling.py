"""Rolling indicator expressions.

Missing values are NULL, never NaN.  Every frame of ``n`` bars yields NULL
until it holds ``n`` non-null values, as a full window is required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spreadlake.functions import order_stats
from spreadlake.series import PAIR, Frame


def let(x: Column, body) -> Column:
    """``body`` applied to the value of ``x``, which is evaluated once.

    A window expression written twice is computed twice, and expressions named
    in an earlier projection are inlined by the optimizer, even into a lambda
    that runs once per element; a lambda argument is neither.
    """
    return F.element_at(F.transform(F.array(x), body), 1)


def clean(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return let(x, lambda v: F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v))


def rounded(x: Column, places: int) -> Column:
    """``x`` to ``places`` decimals as DuckDB's ``round`` gives it: the scaled double to the nearest whole, halves away from zero.

    Spark's own rounds the shortest decimal of ``x``: 4.1234375, a little less as
    a double, becomes 4.123438 there and 4.123437 here.  Values too large to be
    scaled stay.
    """
    y = x * F.lit(10.0**places)
    return F.when(F.abs(y) < F.lit(float("inf")), F.round(y, 0) / F.lit(10.0**places)).otherwise(x)


def full(w: WindowSpec, n: int, x: Column, agg: Column) -> Column:
    return F.when(F.count(x).over(w) >= n, agg.over(w))


def mean(x: Column, n: int, f: Frame = PAIR) -> Column:
    return full(f.last(n), n, x, F.avg(x))


def std(x: Column, n: int, f: Frame = PAIR) -> Column:
    return full(f.last(n), n, x, F.stddev_samp(x))


def total(x: Column, n: int, f: Frame = PAIR) -> Column:
    return full(f.last(n), n, x, F.sum(x))


def ratio(x: Column, y: Column) -> Column:
    """``x / y`` as floating point defines it: over zero an infinity, or NaN for ``0 / 0``; NULL only where a side is missing."""
    return let(y, lambda v: F.coalesce(F.try_divide(x, v), x * F.pow(v, F.lit(-1.0))))


def pct_change(x: Column, k: int = 1, f: Frame = PAIR, ieee: bool = False) -> Column:
    """Change over ``k`` bars; from a zero it is NULL, or with ``ieee`` what :func:`ratio` gives."""
    return (ratio if ieee else F.try_divide)(x, F.lag(x, k).over(f.ordered())) - 1


def log_return(x: Column, f: Frame = PAIR, ieee: bool = False) -> Column:
    """Logarithm of the ratio to the bar before; from or to a zero it is NULL, or with ``ieee`` an infinity (NaN for ``0 / 0`` or a change of sign)."""
    before = F.lag(x, 1).over(f.ordered())
    if not ieee:
        return F.ln(F.try_divide(x, before))
    return let(ratio(x, before), lambda q: F.when(q > 0, F.ln(q)).when(q == 0, F.lit(float("-inf"))).when(q < 0, F.lit(float("nan"))))


def diff(x: Column, k: int = 1, f: Frame = PAIR) -> Column:
    return x - F.lag(x, k).over(f.ordered())


def clip(x: Column, lo, hi) -> Column:
    """NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def holds(cond: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(cond, F.lit(False))


def zscore(x: Column, n: int = 20, f: Frame = PAIR) -> Column:
    if n < 2:
        raise ValueError("window must be at least 2")
    return F.try_divide(x - mean(x, n, f), F.nullif(std(x, n, f), F.lit(0.0)))


def true_range(high: Column, low: Column, close: Column, f: Frame = PAIR) -> Column:
    prev = F.lag(close, 1).over(f.ordered())
    return F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))


def corr(a: Column, b: Column, n: int, f: Frame = PAIR) -> Column:
    """Pearson correlation over the last ``n`` bars with both sides known.

    From the covariance and two deviations: the built-in divides by zero on a
    frame where one side does not move, here such a frame is NULL.
    """
    w = f.last(n)
    x, y = both(a, b, a), both(a, b, b)
    spread = F.nullif(F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w), F.lit(0.0))
    return F.when(F.count(x).over(w) >= n, F.covar_pop(x, y).over(w) / spread)


def autocorr(x: Column, lagged: Column, n: int, f: Frame = PAIR) -> Column:
    """Lag-1 autocorrelation inside the last ``n`` bars; the frame's first bar has no predecessor in it."""
    w = f.last(n - 1)
    a, b = both(x, lagged, x), both(x, lagged, lagged)
    spread = F.nullif(F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w), F.lit(0.0))
    return F.when(F.count(x).over(f.last(n)) >= n, F.covar_pop(a, b).over(w) / spread)


def both(y: Column, x: Column, value: Column) -> Column:
    """``value`` on rows where neither side is missing."""
    return F.when(y.isNotNull() & x.isNotNull(), value)


def beta(y: Column, x: Column, n: int, f: Frame = PAIR) -> Column:
    return clean(full(f.last(n), n, both(y, x, F.lit(1)), F.regr_slope(y, x)))


def alpha(y: Column, x: Column, n: int, f: Frame = PAIR) -> Column:
    """Intercept belonging to :func:`beta`.

    Written through the slope and the two means: together with the slope this
    keeps one covariance per frame in the generated update code instead of two.
    """
    w = f.last(n)
    return F.avg(both(y, x, y)).over(w) - beta(y, x, n, f) * F.avg(both(y, x, x)).over(w)


#: A window whose variance is below this share of its segment's is taken as one that does not move.
STILL = 1e-14


def with_sliding_slope(df: DataFrame, y: Column, x: Column, n: int, out: str, count: str, f: Frame = PAIR, skip: int = 0) -> DataFrame:
    """Least-squares slope of ``y`` on ``x`` over ``n`` bars, and the number of bars with both, at a cost that does not grow with ``n``.

    The frame ends ``skip`` bars before the current one.  Its moments are
    differences of running sums, which start anew in every segment and run over
    values less their segment's mean, so nothing large cancels: slopes agree
    with those of the frames to about 1e-9.
    """
    whole = Window.partitionBy(*f.keys)
    df = df.withColumns({"_y": both(y, x, y), "_x": both(y, x, x)})
    df = df.withColumns({"_my": F.avg("_y").over(whole), "_mx": F.avg("_x").over(whole), "_vx": F.var_pop("_x").over(whole)})
    df = df.withColumns({"_y": F.col("_y") - F.col("_my"), "_x": F.col("_x") - F.col("_mx")})
    c = F.col
    sums = {"_n": F.when(c("_y").isNotNull(), 1), "_sy": c("_y"), "_sx": c("_x"), "_sxx": c("_x") * c("_x"), "_sxy": c("_x") * c("_y")}
    df = df.withColumns({k: F.coalesce(F.sum(v).over(f.running()), F.lit(0)) for k, v in sums.items()})
    o = f.ordered()
    at = lambda k, j: c(k) if j == 0 else F.coalesce(F.lag(k, j).over(o), F.lit(0))
    df = df.withColumns({f"{k}_": at(k, skip) - at(k, skip + n) for k in sums})
    m = c("_n_")
    cov, var = c("_sxy_") / m - c("_sx_") * c("_sy_") / (m * m), c("_sxx_") / m - c("_sx_") * c("_sx_") / (m * m)
    slope = F.when((m > 0) & (var > STILL * c("_vx")), cov / var)
    return df.withColumns({out: slope, count: m}).drop("_y", "_x", "_my", "_mx", "_vx", *sums, *[f"{k}_" for k in sums])


def middle(values: Column) -> Column:
    """Median of a non-empty array."""

    def pick(s: Column) -> Column:
        n = F.size(s)
        lo = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
        return (lo + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2

    return let(F.sort_array(values), pick)


def window_list(x: Column, n: int, f: Frame = PAIR, least: int | None = None) -> Column:
    """The last ``n`` values as an array, NULL until the frame holds ``least`` (default ``n``)."""
    return full(f.last(n), n if least is None else least, x, F.collect_list(x))


def median(x: Column, n: int, f: Frame = PAIR, least: int | None = None) -> Column:
    """Rolling median; sorting the frame's array is far cheaper than a percentile aggregate."""
    return let(window_list(x, n, f, least), lambda v: F.when(v.isNotNull(), middle(v)))


def with_robust_z(df: DataFrame, col: str, n: int, out: str, f: Frame = PAIR) -> DataFrame:
    """Robust z-score: distance to the median in units of the scaled MAD of the same frame.

    Long frames are read off one ranked copy of the segment, short ones sorted.
    """
    x = F.col(col)
    if n >= order_stats.LONG:
        df = order_stats.with_median_and_spread(df, col, n, "_med", "_mad", f)
        return df.withColumn(out, order_stats.robust_score(x, F.col("_med"), F.col("_mad"))).drop("_med", "_mad")
    df = df.withColumn("_frame", window_list(x, n, f))

    def score(med: Column) -> Column:
        mad = middle(F.transform("_frame", lambda v: F.abs(v - med)))
        return let(mad, lambda m: F.when(m != 0, (x - med) / (F.lit(1.4826) * m + F.lit(1e-12))))

    return df.withColumn(out, F.when(F.col("_frame").isNotNull(), let(middle(F.col("_frame")), score))).drop("_frame")


def rank_pct(values: Column, x: Column) -> Column:
    """Average rank of ``x`` among ``values`` divided by their count."""
    below = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    return (below + (equal + 1) / 2) / F.size(values)


def mode_share(values: Column) -> Column:
    """Largest share of one value in the frame."""
    counts = F.transform(F.array_distinct(values), lambda d: F.size(F.filter(values, lambda v: v == d)))
    return F.array_max(counts) / F.size(values)


def max_drawdown_of(values: Column) -> Column:
    """Deepest relative fall from a running peak inside an array."""
    start = F.struct(F.element_at(values, 1).alias("peak"), F.lit(0.0).alias("dd"))

    def step(acc: Column, v: Column) -> Column:
        peak = F.greatest(acc["peak"], v)
        return F.struct(peak.alias("peak"), F.least(acc["dd"], F.coalesce(F.try_divide(v - peak, peak), F.lit(0.0))).alias("dd"))

    return F.aggregate(values, start, step, lambda acc: acc["dd"])


# Odd-power series about zero: all terms positive, full precision for |v| < 8.
_UPPER = """CASE WHEN abs(v) > 8 THEN 1D ELSE 0.5D + exp(-v * v / 2) / 2.5066282746310002D * aggregate(sequence(1, 160),
 named_struct('term', abs(v), 'sum', abs(v)),
 (acc, k) -> named_struct('term', acc.term * v * v / (2 * k + 1), 'sum', acc.sum + acc.term * v * v / (2 * k + 1)), acc -> acc.sum) END"""


def normal_cdf_sql(x: str) -> str:
    """Standard normal distribution of an expression text, evaluated once, without Python."""
    return f"element_at(transform(array({x}), v -> CASE WHEN v >= 0 THEN {_UPPER} ELSE 1D - ({_UPPER}) END), 1)"
