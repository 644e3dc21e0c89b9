"""Combining fast (hourly) and slow (daily) signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlake.functions import rolling as R
from spreadlake.operators.asof import asof_join
from spreadlake.series import PAIR, Frame, segment, trim


@dataclass(frozen=True)
class Weights:
    """Default weights, confidence bounds and exposure caps."""

    fast: float = 0.6
    slow: float = 0.4
    min_fast: float = 0.7
    min_slow: float = 0.8
    cap_fast: float = 0.3
    cap_slow: float = 0.7
    cap_total: float = 1.0
    base: float = 0.1


def align(fast: DataFrame, slow: DataFrame) -> DataFrame:
    """Fast bars with the slow row valid at that time.

    ``fast``: pair, ts, signal, spread_z, fx_price; ``slow``: the same plus good_regime.
    """
    f = fast.select("pair", "ts", F.col("signal").alias("h1_signal"), F.col("spread_z").alias("h1_z"), F.col("fx_price").alias("h1_price"))
    s = slow.select("pair", "ts", F.col("signal").alias("d1_signal"), F.col("spread_z").alias("d1_z"), "good_regime")
    return asof_join(f, s)


def with_confidence(df: DataFrame, f: Frame = PAIR) -> DataFrame:
    """Confidence of both sides in [0, 1], from z-score strength, persistence and regime."""
    c = F.col
    stay = R.let(R.window_list(c("h1_signal"), 4, f), lambda v: F.when(v.isNotNull(), R.mode_share(v)))
    fast = 0.5 + 0.3 * F.abs("h1_z") / 2.0 + 0.2 * stay
    slow = 0.7 + 0.2 * F.abs("d1_z") / 3.0 + 0.1 * c("good_regime").cast("int")
    return df.withColumns(
        {
            "h1_confidence": R.let(fast, lambda v: R.clip(v, 0.0, 1.0)),
            "d1_confidence": R.let(slow, lambda v: R.clip(v, 0.0, 1.0)),
        }
    )


def combine(df: DataFrame, w: Weights = Weights()) -> DataFrame:
    c, h = F.col, R.holds
    df = df.withColumns({"_hv": h(c("h1_confidence") >= w.min_fast), "_dv": h(c("d1_confidence") >= w.min_slow)})
    mixed = w.fast * c("h1_signal") + w.slow * c("d1_signal")
    out = (
        F.when(c("_hv") & c("_dv"), mixed)
        .when(c("_hv"), c("h1_signal") * min(1.5 * w.fast, 1.0))
        .when(c("_dv"), c("d1_signal") * min(1.5 * w.slow, 1.0))
        .otherwise(0.0)
    )
    return df.withColumn("combined_signal", out).drop("_hv", "_dv")


def with_exposure(df: DataFrame, w: Weights = Weights(), f: Frame = PAIR) -> DataFrame:
    c = F.col
    df = df.withColumn("_ret", R.pct_change(c("h1_price"), 1, f))
    factor = F.coalesce(1.0 / (1.0 + R.std(c("_ret"), 24, f)), F.lit(0.5))
    df = df.withColumn("volatility_factor", factor)
    size = w.base * c("volatility_factor") * F.abs("combined_signal")
    df = df.withColumn("position_size", size)
    on = lambda s: F.when(R.holds(F.abs(s) > 0), c("position_size")).otherwise(0.0)
    df = df.withColumns(
        {"h1_exposure": F.least(on("h1_signal"), F.lit(w.cap_fast)), "d1_exposure": F.least(on("d1_signal"), F.lit(w.cap_slow))}
    )
    total = F.least(c("h1_exposure") + c("d1_exposure"), F.lit(w.cap_total))
    return df.withColumn("total_exposure", total).withColumn(
        "final_position", c("total_exposure") * F.signum("combined_signal")
    ).drop("_ret")


def combine_timeframes(fast: DataFrame, slow: DataFrame, w: Weights = Weights()) -> DataFrame:
    df = segment(align(fast, slow), 26)
    return trim(with_exposure(combine(with_confidence(df), w), w)).withColumn("signal_source", F.lit("multi_timeframe"))


def with_fallback(fast: DataFrame, slow: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Signals of pairs known to one side only, weighted and labelled by their source."""
    lone = lambda a, b: a.join(b.select("pair").distinct(), "pair", "left_anti")
    pick = lambda d, k, s: d.select("pair", "ts", (F.col("signal") * k).alias("combined_signal"), F.lit(s).alias("signal_source"))
    return pick(lone(fast, slow), w.fast, "h1_only").unionByName(pick(lone(slow, fast), w.slow, "d1_only"))


def statistics(df: DataFrame) -> DataFrame:
    c = F.col
    return df.groupBy("pair").agg(
        F.count(F.lit(1)).alias("total_signals"),
        F.count_if(c("combined_signal") != 0).alias("active_signals"),
        F.avg(F.abs("final_position")).alias("avg_position_size"),
        F.max("total_exposure").alias("max_exposure"),
    )
