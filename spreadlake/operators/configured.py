"""The signal plan with parameters of its own for every pair.

Window lengths are part of a plan, thresholds are data.  Pairs of equal windows
therefore share one plan, in which their thresholds, limits, sizes and costs are
columns; the plans of the few distinct window sets are united.  The bars are
staged once, in one folder per plan, so each plan reads only its own pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from spreadlake.operators import backtest as B
from spreadlake.operators import signals as S
from spreadlake.series import PAIR, Frame, join_small
from spreadlake.session import stage

#: Parameters that shape a plan; a part that is off has no window and no switch of its own.
SHAPE = ("beta_window", "use_rls", "z_window", "corr_window", "atr_window", "vol_window", "trend_window", "hmm_window", "hmm_df")
#: Parameters that are columns of a plan.
LIMITS = (
    "entry_z", "exit_z", "stop_z", "adf_p", "max_days", "min_abs_corr", "high_vol", "low_vol", "trend_threshold",
    "inverse_fx", "target_vol_per_leg", "vix_thresh", "vix_boost", "vix_max_shift", "fx_bps", "comd_bps", "min_trade_count",
)


def limit(name: str) -> Column:
    """The column that holds a pair's own value."""
    return F.col(f"p_{name}")


def checked(params: DataFrame) -> DataFrame:
    """``params``, if every pair's thresholds are in order; the first pairs that are not are named."""
    bad = params.filter(~((F.col("stop_z") > F.col("entry_z")) & (F.col("entry_z") > F.col("exit_z")))).select("pair").limit(5).collect()
    if bad:
        raise ValueError(f"stop_z must be above entry_z and entry_z above exit_z: {', '.join(sorted(r.pair for r in bad))}")
    return params


def shapes(params: DataFrame) -> DataFrame:
    """One row per pair: its shape with parts that are off left out, and its limits as ``p_`` columns."""
    off = {"vol_window": "filter_vol", "trend_window": "filter_trend", "hmm_window": "enable_hmm", "hmm_df": "enable_hmm"}
    shape = [F.when(F.col(off[c]), F.col(c)).alias(c) if c in off else F.col(c) for c in SHAPE]
    return params.select("pair", *shape, *[F.col(c).alias(f"p_{c}") for c in LIMITS])


def rules_of(shape: Row, vix: bool) -> S.Rules:
    return S.Rules(
        beta_window=shape.beta_window, use_rls=shape.use_rls, z_window=shape.z_window, corr_window=shape.corr_window, atr_window=shape.atr_window,
        entry_z=limit("entry_z"), exit_z=limit("exit_z"), stop_z=limit("stop_z"), adf_p=limit("adf_p"), min_abs_corr=limit("min_abs_corr"),
        max_days=limit("max_days"), target_vol_per_leg=limit("target_vol_per_leg"), inverse_fx=limit("inverse_fx"),
        vol=(shape.vol_window, limit("high_vol"), limit("low_vol")) if shape.vol_window else None,
        trend=(shape.trend_window, limit("trend_threshold")) if shape.trend_window else None,
        hmm=(shape.hmm_window, shape.hmm_df) if shape.hmm_window else None,
        vix=(limit("vix_thresh"), limit("vix_boost"), limit("vix_max_shift").cast("int")) if shape.hmm_window and vix else None,
    )


def plans(bars: DataFrame, params: DataFrame) -> Iterator[tuple[DataFrame, DataFrame, S.Rules]]:
    """The bars, limits and rules of each distinct shape.

    ``params`` is a table as :func:`spreadlake.sources.config.params_frame`
    makes it, one row per pair.  Pairs without a row are left out.
    """
    told = shapes(checked(params))
    kinds = told.select(*SHAPE).distinct().orderBy(*SHAPE).collect()  # as many rows as there are window sets
    same = [F.lit(True)]
    for c in SHAPE:
        same.append(F.col(c).eqNullSafe(F.col(f"k_{c}")))
    numbered = bars.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "plan int, " + ", ".join(f"k_{f.name} {f.dataType.simpleString()}" for f in told.select(*SHAPE).schema))
    on = same[0]
    for s in same[1:]:
        on = on & s
    placed = stage(told.join(numbered, on).select("pair", "plan", *[f"p_{c}" for c in LIMITS]))
    dealt = stage(join_small(bars, placed.select("pair", "plan"), ["pair"]), by=("plan",))
    for i, kind in enumerate(kinds):
        mine = dealt.filter(F.col("plan") == i).drop("plan")
        yield mine, placed.filter(F.col("plan") == i).drop("plan"), rules_of(kind, "vix" in bars.columns)


def generate(bars: DataFrame, params: DataFrame, close_run: bool = False, f: Frame = PAIR) -> DataFrame:
    """Signals of every configured pair, still segmented, with its limits as ``p_`` columns."""
    whole = None
    for mine, limits, rules in plans(bars, params):
        df = S.generate(mine, rules, close_run, f, params=limits)
        whole = df if whole is None else whole.unionByName(df)
    if whole is None:
        raise ValueError("no pair is configured")
    return whole


def backtest(bars: DataFrame, params: DataFrame, f: Frame = PAIR) -> DataFrame:
    """Backtest frame of every configured pair with its own costs."""
    return B.run(generate(bars, params, f=f), limit("fx_bps"), limit("comd_bps"), f=f)


def metrics(bt: DataFrame) -> DataFrame:
    """Headline figures; annual ones only for pairs that made their own least number of trades."""
    c = F.col
    least = bt.groupBy("pair").agg(F.max(limit("min_trade_count")).alias("least"))
    m = B.metrics(bt).join(least, "pair")
    enough = c("num_trades") >= c("least")
    return m.withColumns({k: F.when(enough, c(k)).otherwise(0.0) for k in ("annual_return", "sharpe_ratio")}).drop("least")
