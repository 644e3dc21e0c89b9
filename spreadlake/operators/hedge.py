"""Hedge ratios and spreads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlake.functions import rolling as R
from spreadlake.series import OWN, PAIR, Frame, position, with_series_stats

# Fixed values of the spread definition.
RLS_LAMBDA, RLS_DELTA = 0.995, 100.0
ALPHA_FLOOR, BETA_LIMIT, LOG_FLOOR, FLAT_STD = 1e-8, 10.0, 1e-8, 1e-8


def rls_lookback(lam: float) -> int:
    """Bars after which an observation's weight falls below 1e-17."""
    return math.ceil(math.log(1e-17) / math.log(lam))


def rls(
    df: DataFrame, y: Column, x: Column, lam: float = 0.99, delta: float = 1000.0,
    f: Frame = PAIR, alpha: str = "alpha", beta: str = "beta",
) -> DataFrame:
    """Recursive least squares with forgetting, as five running sums.

    The inverse covariance obeys ``P_t^-1 = lam * P_{t-1}^-1 + x x'``, so the
    state at bar ``t`` is a weighted sum over earlier bars.  Weights are based
    anew in blocks of :func:`rls_lookback` bars, so they stay below 1e17 however
    long a segment is; of the blocks before its own, only the last one still
    weighs anything, and its sums are carried in.  A halo of as many bars makes
    the segment result equal to the whole-series result in double precision.
    """
    block = rls_lookback(lam)
    offset, row = position(f)
    df = df.withColumns({"_off": offset, "_i": row, "_y": y, "_x": x})
    df = df.withColumns({"_blk": F.floor((F.col("_i") - 1) / block), "_k": F.pmod(F.col("_i") - 1, F.lit(block)) + 1})
    xv, yv, w = F.col("_x"), F.col("_y"), F.pow(F.lit(lam), -F.col("_k"))
    terms = {"_a0": w, "_a1": w * xv, "_a2": w * xv * xv, "_b0": w * yv, "_b1": w * xv * yv}
    inside = f.by("_blk").running()
    df = df.withColumns({name: F.sum(term).over(inside) for name, term in terms.items()})
    # the sums at the last row of the block before, seen from every row of this block
    before = F.when(F.col("_k") == block, F.struct(*terms))
    df = df.withColumn("_last", F.last(before, True).over(f.running().rowsBetween(Window.unboundedPreceding, -1)))
    carry = F.pow(F.lit(lam), F.lit(float(block)))
    decay = F.pow(F.lit(lam), F.col("_k"))
    total = {name: decay * (F.col(name) + carry * F.coalesce(F.col("_last")[name], F.lit(0.0))) for name in terms}
    prior = F.pow(F.lit(lam), F.col("_off") + F.col("_i")) / delta
    s0, s1, s2 = total["_a0"] + prior, total["_a1"], total["_a2"] + prior
    r0, r1 = total["_b0"], total["_b1"]
    det = s0 * s2 - s1 * s1
    return df.withColumns(
        {alpha: F.try_divide(r0 * s2 - s1 * r1, det), beta: F.try_divide(s0 * r1 - s1 * r0, det)}
    ).drop("_off", "_i", "_y", "_x", "_blk", "_k", "_last", *terms)


def with_regression(df: DataFrame, y: Column, x: Column, n: int, f: Frame, alpha: str, beta: str) -> DataFrame:
    """Slope and intercept of one frame from one covariance and two means."""
    w = f.last(n)
    df = df.withColumns(
        {
            beta: R.beta(y, x, n, f),
            "_my": F.avg(R.both(y, x, y)).over(w),
            "_mx": F.avg(R.both(y, x, x)).over(w),
        }
    )
    return df.withColumn(alpha, F.col("_my") - F.col(beta) * F.col("_mx")).drop("_my", "_mx")


def rolling_ols(
    df: DataFrame, y: Column, x: Column, window: int, f: Frame = PAIR, alpha: str = "alpha", beta: str = "beta"
) -> DataFrame:
    """Windowed least squares on null-free rows, carried forward over the others."""
    df = df.withColumn("_ok", y.isNotNull() & x.isNotNull())
    g = f.by("_ok")
    df = with_regression(df, y, x, window, g, "_al", "_be")
    fill = lambda c: F.last(c, True).over(f.running())
    return df.withColumns({alpha: fill("_al"), beta: fill("_be")}).drop("_ok", "_al", "_be")


def with_spread(
    df: DataFrame, beta_window: int = 60, use_rls: bool = True, f: Frame = PAIR,
    y: str = "fx_price", x: str = "comd_price", lam: float = RLS_LAMBDA, delta: float = RLS_DELTA,
) -> DataFrame:
    """Spread ``y - alpha * x ** beta`` with ``alpha, beta`` from log prices.

    Bars without two positive finite prices take the previous bar's values.
    Series shorter than the window stay NULL; a series whose log prices do not
    move uses the windowed estimate instead of the recursive one.
    """
    py, px = R.clean(F.col(y)), R.clean(F.col(x))
    ln = lambda p: F.when(p > 0, F.ln(p))
    lx = F.when(F.abs(ln(px)) < LOG_FLOOR, F.lit(LOG_FLOOR)).otherwise(ln(px))
    df = df.withColumns({"_ly": ln(py), "_lx": lx}).withColumn("_valid", F.col("_ly").isNotNull() & F.col("_lx").isNotNull())
    ly, lx = F.col("_ly"), F.col("_lx")
    shape = (
        df.filter(F.col(OWN) & F.col("_valid"))
        .groupBy(*f.series_keys)
        .agg(
            (F.count(F.lit(1)) >= max(beta_window, 10)).alias("_long"),
            ((F.stddev_samp("_ly") < FLAT_STD) | (F.stddev_samp("_lx") < FLAT_STD)).alias("_flat"),
        )
    )
    df = with_series_stats(df, shape, f)
    g = f.by("_valid")
    df = with_regression(df, ly, lx, beta_window, g, "_oa", "_ob")
    if use_rls:
        df = rls(df, ly, lx, lam, delta, g, "_ra", "_rb").withColumns(
            {
                "_oa": F.when(F.col("_flat"), F.col("_oa")).otherwise(F.col("_ra")),
                "_ob": F.when(F.col("_flat"), F.col("_ob")).otherwise(F.col("_rb")),
            }
        ).drop("_ra", "_rb")
    a = F.when(F.col("_valid") & F.col("_long"), F.exp("_oa"))
    df = df.withColumns(
        {
            "_al": F.when(a.isNotNull(), F.greatest(a, F.lit(ALPHA_FLOOR))),
            "_be": F.when(F.col("_valid") & F.col("_long"), R.clip(F.col("_ob"), -BETA_LIMIT, BETA_LIMIT)),
        }
    ).withColumn("_sp", F.col(y) - F.col("_al") * F.pow(F.col(x), F.col("_be")))
    fill = lambda c: F.last(c, True).over(f.running())
    return df.withColumns({"alpha": fill("_al"), "beta": fill("_be"), "spread": fill("_sp")}).drop(
        "_ly", "_lx", "_valid", "_long", "_flat", "_oa", "_ob", "_al", "_be", "_sp"
    )


def with_residuals(df: DataFrame, f: Frame = PAIR, window: int = 20) -> DataFrame:
    """Residual to the rolling mean of the spread, its robust z and a volatility-driven forgetting factor.

    The factor relates residual volatility to its mean over the whole series
    and is therefore a diagnostic, not an input of the spread.
    """
    df = df.withColumn("residual", F.col("spread") - R.mean(F.col("spread"), window, f))
    df = R.with_robust_z(df, "residual", window, "residual_z", f).withColumn("_vol", R.std(F.col("residual"), window, f))
    mean_vol = df.filter(OWN).groupBy(*f.series_keys).agg(F.avg("_vol").alias("_mv"))
    df = with_series_stats(df, mean_vol, f)
    # Fixed values of the forgetting-factor rule.
    lam = R.clip(0.99 - 0.1 * F.try_divide(F.col("_vol"), F.col("_mv")), 0.95, 0.999)
    return df.withColumn("adaptive_lambda", lam).drop("_vol", "_mv")


def window_search(df: DataFrame, windows: list[int], f: Frame = PAIR) -> DataFrame:
    """Windowed spreads for several candidate lengths, long form ``(pair, window, spread)``.

    All candidates share one exchange and one sort: each is a pair of frame
    aggregates in the same projection; the unpivot afterwards is local.
    """
    ly, lx = F.ln("fx_price"), F.ln("comd_price")
    df = df.withColumns(
        {f"_a{w}": R.alpha(ly, lx, w, f) for w in windows} | {f"_b{w}": R.beta(ly, lx, w, f) for w in windows}
    )
    spreads = [
        F.struct(
            F.lit(w).alias("window"),
            (F.col("fx_price") - F.exp(f"_a{w}") * F.pow("comd_price", R.clip(F.col(f"_b{w}"), -BETA_LIMIT, BETA_LIMIT))).alias("spread"),
        )
        for w in windows
    ]
    return df.select(*f.keys, *f.order, OWN, "seg_off", F.explode(F.array(*spreads)).alias("c")).select("*", "c.*").drop("c")
