"""Regime labels, gates and regime features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlake.functions import order_stats
from spreadlake.functions import rolling as R
from spreadlake.series import PAIR, Frame


def correlation_gate(a: Column, b: Column, window: int = 60, min_abs_corr: float = 0.15, f: Frame = PAIR) -> Column:
    if window < 5 or not isinstance(min_abs_corr, Column) and not 0.0 <= min_abs_corr <= 1.0:
        raise ValueError("window must be >= 5 and the threshold within [0, 1]")
    return R.holds(F.abs(R.corr(a, b, window, f)) >= min_abs_corr)


def return_correlation_gate(ra: Column, rb: Column, window: int = 60, threshold: float = 0.15, f: Frame = PAIR) -> Column:
    if window < 20:
        raise ValueError("window must be >= 20")
    return correlation_gate(ra, rb, window, threshold, f)


def volatility_regime(ret: Column, window: int = 20, high: float = 0.03, low: float = 0.003, f: Frame = PAIR) -> Column:
    """0 quiet, 1 normal (and while the window fills), 2 turbulent; bounds inclusive."""
    return R.let(R.std(ret, window, f), lambda v: F.when(v <= low, 0).when(v >= high, 2).otherwise(1))


def trend_regime(ret: Column, window: int = 20, threshold: float = 0.015, f: Frame = PAIR) -> Column:
    """+1 / -1 when the rolling sum of returns is strictly beyond the threshold."""
    return R.let(R.total(ret, window, f), lambda s: F.when(s > threshold, 1).when(s < -threshold, -1).otherwise(0))


def with_returns(df: DataFrame, cols: dict[str, str], f: Frame = PAIR, first_zero: bool = False) -> DataFrame:
    """One-bar returns of several price columns in one projection."""
    out = {n: R.pct_change(F.col(c), 1, f) for n, c in cols.items()}
    if first_zero:
        out = {n: F.coalesce(c, F.lit(0.0)) for n, c in out.items()}
    return df.withColumns(out)


def vix_shift(state: Column, vix: Column, threshold: float = 20.0, factor: float = 0.2, max_shift: int = 1) -> Column:
    """Raise the state where the volatility index is far above its threshold."""
    boost = F.greatest(F.lit(0.0), (vix - threshold) / 10.0 * factor)
    return F.when(R.holds(boost > 0.3) & vix.isNotNull(), F.least(state + max_shift, F.lit(2))).otherwise(state)


def combined_gate(
    df: DataFrame, f: Frame = PAIR, corr_window: int = 20, min_abs_corr: float = 0.15,
    vol: tuple[int, float, float] | None = (20, 0.03, 0.003), trend: tuple[int, float] | None = None,
    strict_trend: bool = False, state: Column | None = None, out: str = "regime_ok", corr: bool = True,
) -> DataFrame:
    """Conjunction of the configured gates.

    The trend gate accepts every state unless ``strict_trend`` asks for the
    ranging state; a hidden-state column, when given, must be 0.  Without
    ``corr`` the correlation gate is open.
    """
    df = with_returns(df, {"_rf": "fx_price", "_rc": "comd_price"}, f, first_zero=True)
    ok = correlation_gate(F.col("fx_price"), F.col("comd_price"), corr_window, min_abs_corr, f) if corr else F.lit(True)
    if vol is not None:
        for leg in ("_rf", "_rc"):
            ok = ok & (volatility_regime(F.col(leg), *vol, f=f) != 2)
    if trend is not None:
        for leg in ("_rf", "_rc"):
            t = trend_regime(F.col(leg), *trend, f=f)
            ok = ok & ((t == 0) if strict_trend else (F.abs(t) <= 1))
    if state is not None:
        ok = ok & R.holds(state == 0)
    return df.withColumn(out, ok).drop("_rf", "_rc")


def spread_return(df: DataFrame, f: Frame = PAIR, beta: str = "beta", out: str = "spread_ret") -> DataFrame:
    """Log return of the first leg minus beta times that of the second."""
    return df.withColumn(
        out, R.log_return(F.col("fx_price"), f) - F.col(beta) * R.log_return(F.col("comd_price"), f)
    )


# --- feature set -------------------------------------------------------------------------------


def volatility_percentile(df: DataFrame, price: str, window: int = 20, history: int = 120, f: Frame = PAIR) -> DataFrame:
    """Realised volatility and its place among its own recent quantiles (1/3, 2/3)."""
    df = df.withColumn("_ret", R.pct_change(F.col(price), 1, f))
    df = df.withColumn("feat_volatility_value", R.std(F.col("_ret"), window, f))
    v = F.col("feat_volatility_value")
    df = order_stats.with_quantiles(df, "feat_volatility_value", history, {"_q1": 1 / 3, "_q2": 2 / 3}, f)
    label = F.when(v <= F.col("_q1"), "low").when(v > F.col("_q2"), "high").when(F.col("_q1").isNotNull(), "normal")
    return df.withColumn("feat_volatility_regime", label).drop("_ret", "_q1", "_q2")


def cycle_phase(trend: Column, inventory_change: Column) -> Column:
    """Commodity cycle phase from price trend and inventory change."""
    up, building = trend > 0, inventory_change > 0
    return (
        F.when(trend.isNull() | inventory_change.isNull(), F.lit(None).cast("string"))
        .when(up & ~building, "expansion")
        .when(up & building, "peak")
        .when(~up & building, "contraction")
        .otherwise("trough")
    )


def volume_features(df: DataFrame, price: str, volume: str, window: int = 20, f: Frame = PAIR) -> DataFrame:
    """Volume-weighted return, volume spike and volume-adjusted return; absent volume counts as 1."""
    df = df.withColumns({"_ret": R.pct_change(F.col(price), 1, f), "_vol": F.coalesce(F.col(volume), F.lit(1.0))})
    r, v = F.col("_ret"), F.col("_vol")
    df = df.withColumns(
        {
            "feat_vwret": F.try_divide(R.total(r * v, window, f), R.total(F.when(r.isNotNull(), v), window, f)),
            "feat_volume_spike": F.try_divide(v, R.mean(v, window, f)),
        }
    )
    return df.withColumn("feat_vol_adj_ret", r * F.col("feat_volume_spike")).drop("_ret", "_vol")


def liquidity_sweep(df: DataFrame, window: int = 14, f: Frame = PAIR) -> DataFrame:
    """Bars whose wick pierces the previous extreme by the ATR scale and closes back inside."""
    df = df.withColumn("_tr", R.true_range(F.col("high"), F.col("low"), F.col("close"), f))
    o = f.ordered()
    df = df.withColumns(
        {
            "_atr": R.mean(F.col("_tr"), window, f),
            "_ph": F.lag("high").over(o),
            "_pl": F.lag("low").over(o),
            "_av": R.mean(F.col("volume"), window, f),
        }
    )
    upper = F.col("high") - F.greatest("open", "close")
    lower = F.least("open", "close") - F.col("low")
    wick = F.try_divide(F.greatest(upper, lower), F.col("_atr"))
    spike = F.try_divide(F.col("volume"), F.col("_av"))
    swept = ((F.col("high") > F.col("_ph")) & (F.col("close") < F.col("_ph"))) | (
        (F.col("low") < F.col("_pl")) & (F.col("close") > F.col("_pl"))
    )
    return df.withColumns(
        {
            "feat_sweep_score": F.when(R.holds(swept), wick * spike).otherwise(F.when(wick.isNotNull() & spike.isNotNull(), F.lit(0.0))),
            "feat_sweep": R.holds(swept & (wick >= 0.5)),
        }
    ).drop("_tr", "_atr", "_ph", "_pl", "_av")


def trend_features(df: DataFrame, price: str, horizons: tuple[int, ...] = (10, 20, 60), fast: int = 10, slow: int = 50, f: Frame = PAIR) -> DataFrame:
    """Regression slopes over several horizons and the moving-average crossover sign."""
    df = df.withColumn("_n", F.row_number().over(f.ordered()).cast("double"))
    p = F.col(price)
    df = df.withColumns({f"feat_slope_{h}": R.beta(p, F.col("_n"), h, f) for h in horizons})
    cross = F.signum(R.mean(p, fast, f) - R.mean(p, slow, f))
    return df.withColumn("feat_ma_cross", cross).drop("_n")


def directional_index(df: DataFrame, window: int = 14, f: Frame = PAIR) -> DataFrame:
    """Average directional index with simple moving averages."""
    o = f.ordered()
    up = F.col("high") - F.lag("high").over(o)
    down = F.lag("low").over(o) - F.col("low")
    df = df.withColumns({"_tr": R.true_range(F.col("high"), F.col("low"), F.col("close"), f), "_up": up, "_dn": down})
    df = df.withColumns(
        {
            "_pdm": F.when(F.col("_up").isNull(), F.lit(None)).when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0),
            "_mdm": F.when(F.col("_up").isNull(), F.lit(None)).when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0),
        }
    )
    tr = R.mean(F.col("_tr"), window, f)
    df = df.withColumns(
        {
            "_pdi": F.try_divide(R.mean(F.col("_pdm"), window, f) * 100, tr),
            "_mdi": F.try_divide(R.mean(F.col("_mdm"), window, f) * 100, tr),
        }
    )
    df = df.withColumn("_dx", F.try_divide(F.abs(F.col("_pdi") - F.col("_mdi")) * 100, F.col("_pdi") + F.col("_mdi")))
    return df.withColumn("feat_adx", R.mean(F.col("_dx"), window, f)).drop("_tr", "_up", "_dn", "_pdm", "_mdm", "_pdi", "_mdi", "_dx")


def shifted_features(df: DataFrame, k: int = 1, f: Frame = PAIR) -> DataFrame:
    """Every ``feat_*`` column moved ``k`` bars later, so that a bar sees only the past."""
    feats = [c for c in df.columns if c.startswith("feat_")]
    return df.withColumns({c: F.lag(c, k).over(f.ordered()) for c in feats})


def state_transitions(df: DataFrame, state: str, f: Frame = PAIR, states: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Row-normalised transition shares between consecutive states."""
    df = df.withColumn("from_state", F.lag(state).over(f.ordered())).filter("own AND from_state IS NOT NULL")
    counts = df.groupBy(*f.series_keys, "from_state").pivot(state, list(states)).count()
    total = sum((F.coalesce(F.col(str(s)), F.lit(0)) for s in states), F.lit(0))
    return counts.select(
        *f.series_keys, "from_state", *[(F.coalesce(F.col(str(s)), F.lit(0)) / total).alias(f"to_{s}") for s in states]
    )
