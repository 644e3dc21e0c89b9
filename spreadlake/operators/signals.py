"""Entry, exit and stop rules, positions, sizing and holding limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlake.functions import order_stats
from spreadlake.functions import rolling as R
from spreadlake.operators import hedge, hidden_states, regime, structure
from spreadlake.operators.states import position_states
from spreadlake.series import OWN, PAIR, Frame, segment, trim, with_series_stats
from spreadlake.session import stage


@dataclass(frozen=True)
class Rules:
    """Window lengths and thresholds of the daily spread strategy.

    Thresholds, limits and targets may be columns: those of a parameter table
    with one row per pair (see :mod:`spreadlake.operators.configured`).
    """

    beta_window: int = 60
    z_window: int = 20
    corr_window: int = 20
    entry_z: float = 1.5
    exit_z: float = 0.5
    stop_z: float = 3.5
    adf_p: float = 0.10
    min_abs_corr: float = 0.15
    use_rls: bool = True
    max_days: int = 10
    atr_window: int = 20
    target_vol_per_leg: float = 0.01
    inverse_fx: bool = True
    vol: tuple[int, float, float] | None = None
    trend: tuple[int, float] | None = None
    #: (window, degrees of freedom) of the hidden-state gate; (threshold, factor, largest shift) of its volatility-index shift.
    hmm: tuple[int, float] | None = None
    vix: tuple[float, float, int] | None = None
    tail: int = 8
    #: Parts that an ablation switches off: scales of the thresholds, correlation gate, robust z-score.
    structural_scale: bool = True
    vol_scale: bool = True
    corr_gate: bool = True
    robust_z: bool = True

    @property
    def lookback(self) -> int:
        """Bars before a segment that decide its own first bar."""
        estimate = hedge.rls_lookback(hedge.RLS_LAMBDA) if self.use_rls else self.beta_window
        states = self.hmm[0] + 1 if self.hmm else 0
        return estimate + self.z_window + 252 + 20 + self.corr_window + self.atr_window + self.tail + states + 4


def spread_and_z(df: DataFrame, rules: Rules, f: Frame = PAIR) -> DataFrame:
    df = hedge.with_spread(df, rules.beta_window, rules.use_rls, f)
    if not rules.robust_z:
        return df.withColumn("spread_z", R.zscore(F.col("spread"), rules.z_window, f))
    return R.with_robust_z(df, "spread", rules.z_window, "spread_z", f)


def dynamic_thresholds(
    df: DataFrame, entry_z, exit_z, coint_ok: Column, f: Frame = PAIR, structural_scale: bool = True, vol_scale: bool = True
) -> DataFrame:
    """Thresholds scaled by recent spread volatility and by the structural flag; a scale switched off is 1."""
    df = df.withColumn("_v", R.std(F.col("spread"), 20, f))
    df = order_stats.with_median(df, "_v", 252, "_m", f, least=20)
    scale = F.coalesce(R.clip(F.try_divide(F.col("_v"), F.nullif(F.col("_m"), F.lit(0.0))), 0.7, 1.5), F.lit(1.0)) if vol_scale else F.lit(1.0)
    structural = F.when(coint_ok, 0.9).otherwise(1.1) if structural_scale else F.lit(1.0)
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumns(
        {
            "entry_z_dyn": F.greatest(F.lit(0.8), lit(entry_z) * structural * scale),
            "exit_z_dyn": F.least(F.lit(1.25), lit(exit_z) / structural * scale),
        }
    ).drop("_v", "_m")


def rule_flags(df: DataFrame, entry: Column, exit_: Column, stop: Column, gate: Column, reversed_stops: bool = False) -> DataFrame:
    """Boolean rule columns; ``reversed_stops`` keeps the literal hourly/daily stop direction."""
    z = F.col("spread_z")
    h = R.holds
    return df.withColumns(
        {
            "enter_long": h((z <= -entry) & gate),
            "enter_short": h((z >= entry) & gate),
            "long_exit": h(z >= -exit_),
            "short_exit": h(z <= exit_),
            "long_stop": h(z >= -stop) if reversed_stops else h(z <= -stop),
            "short_stop": h(z <= stop) if reversed_stops else h(z >= stop),
            "long_profit": F.lit(False),
            "short_profit": F.lit(False),
        }
    )


def positions(df: DataFrame, gate: Column | None = None, max_bars: int | None = None, tail: int = 8, f: Frame = PAIR) -> DataFrame:
    c = F.col
    return position_states(
        df, c("enter_long"), c("enter_short"), c("long_exit") | c("long_stop"), c("short_exit") | c("short_stop"),
        gate, max_bars, tail, f,
    )


def transition_flags(df: DataFrame, f: Frame = PAIR) -> DataFrame:
    """``entry``: the signal moved by one (exits included); ``exit``: it moved to zero."""
    d = R.diff(F.col("signal"), 1, f)
    return df.withColumns({"entry": R.holds(F.abs(d) == 1), "exit": R.holds((d != 0) & (F.col("signal") == 0))})


def sizes(df: DataFrame, atr_window: int = 20, target: float = 0.01, inverse_fx: bool = True, f: Frame = PAIR) -> DataFrame:
    """Inverse-volatility leg sizes from the mean absolute price change."""
    df = df.withColumns({f"_d{c}": F.abs(R.diff(F.col(c), 1, f)) for c in ("fx_price", "comd_price")})
    size = lambda c: F.try_divide(F.lit(target), R.mean(F.col(f"_d{c}"), atr_window, f))
    fx = size("fx_price")
    inverse = F.try_divide(fx, F.col("fx_price"))
    if isinstance(inverse_fx, Column):
        fx = F.when(inverse_fx, inverse).otherwise(fx)
    elif inverse_fx:
        fx = inverse
    return df.withColumns({"fx_size": fx, "comd_size": size("comd_price")}).drop("_dfx_price", "_dcomd_price")


def leg_positions(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"fx_position": F.col("fx_size") * F.col("signal"), "comd_position": -F.col("comd_size") * F.col("signal")}
    )


def holding_limit(half_life: Column, max_days: int | Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.bround(3 * half_life, 0).cast("int"), F.lit(max_days)))


def time_stop(df: DataFrame, limit: Column, close_run: bool = False, f: Frame = PAIR) -> DataFrame:
    """Zero the first bar of a run held for ``limit`` calendar days.

    By default the run resumes on the following bar; ``close_run`` ends it.
    ``since`` (start of the visible run) comes with the position, so the rule
    needs only the previous bar, however long the run is.
    """
    day_us = 86_400_000_000
    held = F.floor((F.unix_micros("ts") - F.unix_micros("since")) / day_us)
    before = F.floor((F.unix_micros(F.lag("ts").over(f.ordered())) - F.unix_micros("since")) / day_us)
    live = (F.col("signal") != 0) & (F.col("ts") > F.col("since"))
    hit = R.holds(live & (held >= limit) & (before < limit))
    over = R.holds(live & (held >= limit))
    return df.withColumns(
        {"time_stop_exit": hit, "signal": F.when(over if close_run else hit, 0).otherwise(F.col("signal"))}
    )


def flagged_bars(bars: DataFrame, rules: Rules, f: Frame = PAIR, params: DataFrame | None = None) -> DataFrame:
    """Segmented bars with spread, z-score and the combined gate.

    With ``rules.hmm`` the gate also asks for hidden state 0, shifted by the
    bars' ``vix`` column where ``rules.vix`` is set; bars that come with a
    column ``hmm_state`` are not fitted again.  ``params`` has the columns that
    ``rules`` name, one row per series.
    """
    df = segment(bars, rules.lookback, f.series_keys, reuse=True)
    if params is not None:
        df = with_series_stats(df, params, f)
    df = spread_and_z(df, rules, f)
    state = None
    if rules.hmm:
        window, dof = rules.hmm
        if "hmm_state" not in bars.columns:
            df = hidden_states.hidden_regime(regime.spread_return(df, f), "spread_ret", window=window, dof=dof, f=f)
        state = F.col("hmm_state")
        if rules.vix:
            state = regime.vix_shift(state, F.col("vix"), *rules.vix)
    return regime.combined_gate(
        df, f, rules.corr_window, rules.min_abs_corr, rules.vol, rules.trend, state=state, out="regime_ok", corr=rules.corr_gate
    )


def generate(
    bars: DataFrame, rules: Rules = Rules(), close_run: bool = False, f: Frame = PAIR, fit: Column | None = None, params: DataFrame | None = None
) -> DataFrame:
    """Signals of every pair: spread to sized, time-limited positions, still segmented.

    Rows in the last ``tail`` halo bars of each segment are right as well, so a
    backtest may look back a few bars; call :func:`spreadlake.series.trim` to
    get each bar once.  The structural statistics of a series come from the
    bars that ``fit`` selects, the first ones of the series; by default all.
    """
    df = stage(flagged_bars(bars, rules, f, params))
    stats = structure.structural_flag(df if fit is None else df.filter(fit), "spread", f, rules.adf_p, limits=params).select(
        *f.series_keys, "coint_ok", "adf_p", F.col("half_life").alias("ou_half_life"), "hurst"
    )
    stats = stage(stats)  # a row per pair, needed by both passes of the position scan
    df = with_series_stats(df, stats, f)
    # the combined gate already contains the correlation gate
    df = df.withColumn("good_regime", F.col("regime_ok"))
    df = dynamic_thresholds(df, rules.entry_z, rules.exit_z, F.col("coint_ok"), f, rules.structural_scale, rules.vol_scale)
    df = rule_flags(df, F.col("entry_z_dyn"), F.col("exit_z_dyn"), F.lit(rules.stop_z), F.col("good_regime"))
    df = sizes(df, rules.atr_window, rules.target_vol_per_leg, rules.inverse_fx, f)
    df = positions(df, F.col("regime_ok"), None, rules.tail, f)
    df = time_stop(df, holding_limit(F.col("ou_half_life"), rules.max_days), close_run, f)
    return leg_positions(transition_flags(df, f))


def signals_table(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return trim(generate(bars, rules))


def bounded_hold_signals(
    bars: DataFrame, rules: Rules, max_bars: int, any_gate: bool, reversed_stops: bool = False, f: Frame = PAIR
) -> DataFrame:
    """Static-threshold strategy with a bar-count limit.

    ``any_gate`` accepts a bar when correlation *or* stationarity holds (hourly
    variant); otherwise both must (daily variant).
    """
    df = stage(spread_and_z(segment(bars, rules.lookback, reuse=True), rules, f))
    test = stage(structure.unit_root_test(df, "spread", f).select(*f.series_keys, "adf_p"))
    df = with_series_stats(df, test, f)
    corr_ok = regime.correlation_gate(F.col("fx_price"), F.col("comd_price"), rules.corr_window, rules.min_abs_corr, f)
    adf_ok = R.holds(F.col("adf_p") <= rules.adf_p)
    df = df.withColumn("good_regime", (corr_ok | adf_ok) if any_gate else (corr_ok & adf_ok))
    df = rule_flags(df, F.lit(rules.entry_z), F.lit(rules.exit_z), F.lit(rules.stop_z), F.col("good_regime"), reversed_stops)
    df = sizes(df, rules.atr_window, rules.target_vol_per_leg, rules.inverse_fx, f)
    df = positions(df, None, max_bars, rules.tail, f)
    return leg_positions(transition_flags(df, f))


def adjusted_thresholds(
    df: DataFrame, entry: float, exit_: float, stop: float, vol_window: int = 20, factor: float = 1.0, f: Frame = PAIR
) -> DataFrame:
    """Thresholds moved with the volatility of z relative to its series mean (full-sample)."""
    df = df.withColumn("_sv", R.std(F.col("spread_z"), vol_window, f))
    mean = df.filter(OWN).groupBy(*f.series_keys).agg(F.avg("_sv").alias("_mv"))
    df = with_series_stats(df, mean, f)
    adj = 1.0 + factor * F.try_divide(F.col("_sv") - F.col("_mv"), F.col("_mv"))
    floor = lambda base, lo: F.when(adj.isNotNull(), F.greatest(base * adj, F.lit(lo)))
    df = df.withColumns(
        {"entry_threshold": floor(entry, 0.5), "_x": floor(exit_, 0.2), "stop_threshold": floor(stop, 2.0)}
    )
    x = F.when(adj.isNotNull(), F.least(F.col("_x"), F.col("entry_threshold") * 0.8))
    return df.withColumn("exit_threshold", x).drop("_sv", "_mv", "_x")


def enhanced_signals(
    bars: DataFrame, rules: Rules, vol_adjusted: bool = True, reversed_stops: bool = False, f: Frame = PAIR
) -> DataFrame:
    """Ungated signals with optional volatility-adjusted thresholds."""
    df = stage(spread_and_z(segment(bars, rules.lookback, reuse=True), rules, f))
    if vol_adjusted:
        df = adjusted_thresholds(df, rules.entry_z, rules.exit_z, rules.stop_z, f=f)
    else:
        df = df.withColumns(
            {"entry_threshold": F.lit(rules.entry_z), "exit_threshold": F.lit(rules.exit_z), "stop_threshold": F.lit(rules.stop_z)}
        )
    df = rule_flags(df, F.col("entry_threshold"), F.col("exit_threshold"), F.col("stop_threshold"), F.lit(True), reversed_stops)
    return positions(df, None, None, rules.tail, f)


def quality(df: DataFrame, signal: str, ret: str, window: int = 20, f: Frame = PAIR) -> DataFrame:
    """Rolling quality of a signal: signal-to-noise, predictive power, stability, win rate, consistency."""
    s, r = F.col(signal).cast("double"), F.col(ret)
    o = f.ordered()
    df = df.withColumns(
        {
            "_s": s,
            "_next": F.lead(r).over(o),
            "_lag": F.lag(s).over(o),
            "_win": F.when((s * r > 0) & (F.abs(s) > 0), 1.0).otherwise(0.0),
            "_chg": F.abs(R.diff(s, 1, f)),
        }
    )
    x = F.col("_s")
    return df.withColumns(
        {
            "signal_to_noise": R.mean(x, window, f) / (R.std(x, window, f) + 1e-8),
            "predictive_power": R.corr(x, F.col("_next"), window, f),
            "signal_stability": R.autocorr(x, F.col("_lag"), window, f),
            "win_rate": R.mean(F.col("_win"), window, f),
            "signal_consistency": 1.0 - R.mean(F.col("_chg"), window, f),
        }
    ).drop("_s", "_next", "_lag", "_win", "_chg")


def run_lengths(df: DataFrame, signal: str = "signal", f: Frame = PAIR) -> DataFrame:
    """Average number of bars per stretch between signal changes.

    Stretches are numbered by a running count of changes.  A flat stretch counts
    one bar (the bar of its change), a held stretch all its bars; bars before
    the first change count only while the signal is on, without the first bar.
    """
    from spreadlake.series import running_sum

    df = df.withColumn("_prev", F.lag(signal).over(f.ordered()))
    changed = R.holds(F.col(signal) != F.col("_prev"))
    df = df.withColumn("_changed", changed)
    df = running_sum(df, {"_run": F.col("_changed").cast("int")}, f).filter(OWN)
    counted = F.when(F.col("_changed") | (F.col("_prev").isNotNull() & (F.col(signal) != 0)), 1).otherwise(0)
    runs = df.groupBy(*f.series_keys, "_run").agg(F.sum(counted).alias("n"))
    return runs.groupBy(*f.series_keys).agg(F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("n"))), F.lit(0.0)).alias("avg_signal_duration"))


def diagnostics(signals: DataFrame, f: Frame = PAIR) -> DataFrame:
    """Run diagnostics per pair, from segmented signals."""
    df = signals.withColumn("_gap", F.abs(R.pct_change(F.col("fx_price"), 1, f)) > 0.05).filter(OWN)
    return df.groupBy(*f.series_keys).agg(
        F.count(F.lit(1)).alias("observations"),
        (F.avg(F.col("good_regime").cast("double")) * 100).alias("regime_pct"),
        F.avg(F.when(F.col("entry"), F.abs("spread_z"))).alias("mean_abs_z_at_entry"),
        F.max("adf_p").alias("adf_p"),
        F.count_if("_gap").alias("gap_days"),
    )
