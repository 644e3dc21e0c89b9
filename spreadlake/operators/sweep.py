"""Parameter grids, sweeps, rankings and walk-forward evaluation."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadlake.functions import rolling as R
from spreadlake.operators import backtest as B
from spreadlake.operators import hidden_states, regime
from spreadlake.operators import signals as S
from spreadlake.series import OWN, PAIR, Frame, compound, position, segment, trim, with_series_stats
from spreadlake.session import stage

# The optimizer's threshold grid and the parallel runner's grid.
ENTRY, EXIT, STOP = [0.8, 1.0, 1.2, 1.5, 1.8, 2.0], [0.3, 0.5, 0.7, 0.9], [2.5, 3.0, 3.5, 4.0]
RUN_ENTRY, RUN_EXIT, RUN_STOP = [1.0, 1.5, 2.0, 2.5], [0.3, 0.5, 0.7], [2.5, 3.0, 3.5, 4.0]


def _grid(spark: SparkSession, entry, exit_, stop, keep) -> DataFrame:
    combos = [c for c in itertools.product(entry, exit_, stop) if keep(*c)]
    rows = [(i + 1, *c) for i, c in enumerate(combos)]
    return spark.createDataFrame(rows, "param_id int, entry_z double, exit_z double, stop_z double")


def threshold_grid(spark: SparkSession, entry=None, exit_=None, stop=None) -> DataFrame:
    return _grid(spark, entry or ENTRY, exit_ or EXIT, stop or STOP, lambda e, x, s: e > x and x < s)


def run_grid(spark: SparkSession, entry=None, exit_=None, stop=None) -> DataFrame:
    return _grid(spark, entry or RUN_ENTRY, exit_ or RUN_EXIT, stop or RUN_STOP, lambda e, x, s: e > x and s > e)


def with_grid(bars: DataFrame, combos: list[tuple[int, float, float, float]]) -> DataFrame:
    """Each bar once per parameter set.

    The grid is a constant array exploded next to the bars after their
    exchange, so the copies are made where the bars are and are not shuffled.
    """
    grid = F.array(
        *[
            F.struct(F.lit(i).alias("param_id"), F.lit(e).alias("entry_z"), F.lit(x).alias("exit_z"), F.lit(s).alias("stop_z"))
            for i, e, x, s in combos
        ]
    )
    return bars.withColumn("_p", F.explode(grid)).select("*", "_p.*").drop("_p")


def average_rank(df: DataFrame, col: str, keys: tuple[str, ...] = ("pair",), out: str = "rank") -> DataFrame:
    """Descending rank with ties sharing their mean (over result rows, one per parameter set)."""
    w = Window.partitionBy(*keys).orderBy(F.col(col).desc())
    ties = Window.partitionBy(*keys, col)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def best(results: DataFrame, metric: str, n: int, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Top results by a metric, larger is better (drawdowns are negative), NULLs left out."""
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc(), F.col("param_id"))
    return results.filter(F.col(metric).isNotNull()).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


# --- walk-forward -------------------------------------------------------------------------------


def folds(spark: SparkSession, first_year: int, train: int, test: int, step: int, count: int) -> DataFrame:
    rows = [
        (k + 1, f"{first_year + k * step}-01-01", f"{first_year + k * step + train}-01-01", f"{first_year + k * step + train + test}-01-01")
        for k in range(count)
    ]
    cast = ", ".join(f"cast({c} as timestamp) {c}" for c in ("train_start", "train_end", "test_end"))
    return spark.createDataFrame(rows, "fold int, train_start string, train_end string, test_end string").selectExpr("fold", *cast.split(", "))


def assign_folds(df: DataFrame, first_year: int, train: int, test: int, step: int, count: int) -> DataFrame:
    """Each bar once per fold it belongs to, with its part (train or test).

    Folds are evenly spaced, so a bar's folds follow from its year by
    arithmetic; no interval join is needed.
    """
    y = F.year("ts") - first_year
    k = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    df = df.withColumn("_y", y).withColumn("_k", k)
    off = F.col("_y") - F.col("_k") * step
    part = F.when((off >= 0) & (off < train), "train").when((off >= train) & (off < train + test), "test")
    return df.withColumn("part", part).filter("part IS NOT NULL").withColumn("fold", F.col("_k") + 1).drop("_y", "_k")


def purge(df: DataFrame, boundary: Column, row: Column, purge_bars: int = 40, embargo_bars: int = 20) -> DataFrame:
    """Drop training bars just before and test bars just after the boundary row."""
    gap = row - boundary
    return df.filter(~((gap < 0) & (gap >= -purge_bars)) & ~((gap >= 0) & (gap < embargo_bars)))


def purge_folds(df: DataFrame, keys: tuple[str, ...] = ("pair", "param_id"), purge_bars: int = 40, embargo_bars: int = 20) -> DataFrame:
    """In every fold, drop the last training bars and the first test bars."""
    part = Window.partitionBy(*keys, "fold", "part")
    up, down = F.row_number().over(part.orderBy("ts")), F.row_number().over(part.orderBy(F.col("ts").desc()))
    place = df.withColumns({"_up": up, "_down": down})
    keep = ((F.col("part") == "train") & (F.col("_down") > purge_bars)) | ((F.col("part") == "test") & (F.col("_up") > embargo_bars))
    return place.filter(keep).drop("_up", "_down")


def freeze_best(train: DataFrame, test: DataFrame, keys: tuple[str, ...] = ("pair", "fold")) -> DataFrame:
    """Test rows of the parameter set that was best in training (Sharpe, then profit factor, then drawdown)."""
    w = Window.partitionBy(*keys).orderBy(
        F.col("sharpe_ratio").desc(), F.col("profit_factor").desc(), F.col("max_drawdown").desc(), F.col("param_id")
    )
    chosen = train.withColumn("_p", F.row_number().over(w)).filter("_p = 1").select(*keys, "param_id")
    return test.join(chosen, [*keys, "param_id"])


def accept(test: DataFrame) -> DataFrame:
    """Out-of-sample acceptance per pair: medians, worst drawdown, no fold that dominates and none without a trade."""
    c = F.col
    gain = F.when(c("total_return") > 0, c("total_return")).otherwise(0.0)
    t = test.groupBy("pair").agg(
        F.percentile("sharpe_ratio", F.lit(0.5)).alias("median_sharpe"),
        F.percentile("profit_factor", F.lit(0.5)).alias("median_pf"),
        F.min("max_drawdown").alias("worst_dd"),
        F.try_divide(F.max(gain), F.sum(gain)).alias("top_fold_share"),
        F.min("num_trades").alias("fewest_trades"),
    )
    ok = (c("fewest_trades") > 0) & (c("median_sharpe") >= 0.2) & (c("median_pf") >= 1.2) & (c("worst_dd") >= -0.25) & (F.coalesce("top_fold_share", F.lit(0.0)) <= 0.6)
    return t.withColumn("accepted", R.holds(ok))


# Cumulative Poisson(1) probabilities.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
#: Keys whose sums a task holds before it gives them on.
HELD = 1024


def replicate_weights(h: np.ndarray, replicates: int) -> np.ndarray:
    """Unit-rate Poisson weights, one row per hash and one column per replicate: a mix of both numbers' bits."""
    x = h.astype(np.uint64)[:, None] + (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(POISSON, u, side="right")


def bootstrap(df: DataFrame, value: str, order: list[str], replicates: int = 200, seed: int = 42, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Bootstrap distribution of a mean: unit-rate Poisson weights from a hash of row and replicate.

    Weights are a function of the row, so the result does not depend on
    partitioning or on a lost task being run again.  A task adds up all
    replicates of its rows as arrays; only sums leave it, no copies of rows.
    Missing values are left out.
    """
    names = [f"k{i}" for i in range(len(keys))]
    given = df.filter(F.col(value).isNotNull()).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("v"), F.xxhash64(*[F.col(k) for k in (*keys, *order)], F.lit(seed)).alias("h")
    )

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            rows = [(*k, r + 1, *x) for k, sums in held.items() for r, x in enumerate(sums.T.tolist())]
            held.clear()
            return pd.DataFrame(rows, columns=[*names, "rep", "w", "wv"])

        for frame in frames:
            for key, part in frame.groupby(names, dropna=False, sort=False):
                for at in range(0, len(part), 4096):
                    some = part.iloc[at : at + 4096]
                    weights = replicate_weights(some["h"].to_numpy(), replicates)
                    sums = np.stack([weights.sum(axis=0).astype(float), some["v"].to_numpy() @ weights])
                    held[key] = held[key] + sums if key in held else sums
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    fields = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for k, n in zip(keys, names))
    sums = given.mapInPandas(added, f"{fields}, rep int, w double, wv double")
    means = sums.groupBy(*[F.col(n).alias(k) for k, n in zip(keys, names)], "rep").agg(F.try_divide(F.sum("wv"), F.sum("w")).alias("m"))
    return means.groupBy(*keys).agg(
        F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"),
        F.avg((F.col("m") <= 0).cast("double")).alias("p_value"),
    )


def ablations(base: S.Rules) -> dict[str, S.Rules]:
    """The documented ablations: the plan whole, and with one part switched off at a time."""
    return {
        "A0_baseline": base,
        "A1_no_hmm": replace(base, hmm=None, vix=None),
        "A2_no_structural_scale": replace(base, structural_scale=False),
        "A3_no_vol_scale": replace(base, vol_scale=False),
        "A4_no_corr_gate": replace(base, corr_gate=False),
        "A5_plain_z": replace(base, robust_z=False),
    }


FOLD_FRAME = Frame(keys=("pair", "fold", "seg"))


def marked_parts(folds: DataFrame, f: Frame = FOLD_FRAME, purge_bars: int = 40, embargo_bars: int = 20) -> DataFrame:
    """Bars of the folds with ``use``: train or test, null for the last training and the first test bars.

    No bar goes, so a strategy runs over a fold without a gap.
    """
    off, row = position(f)
    df = stage(segment(folds, 1, f.series_keys, reuse=True).withColumn("_row", off + row))
    cut = stage(df.filter(F.col(OWN) & (F.col("part") == "train")).groupBy(*f.series_keys).agg(F.max("_row").alias("_cut")))
    df = trim(with_series_stats(df, cut, f))
    gap = F.col("_row") - F.coalesce("_cut", F.lit(0))
    use = F.when((F.col("part") == "train") & (gap <= -purge_bars), "train").when((F.col("part") == "test") & (gap > embargo_bars), "test")
    return df.withColumn("use", use).drop("_row", "_cut")


def with_states(bars: DataFrame, rules: S.Rules, f: Frame = PAIR) -> DataFrame:
    """Bars with the ``hmm_state`` that ``rules`` ask for, fitted once for folds and plans that share it.

    A state looks back only, so that of a bar is the same in every fold.
    """
    df = S.spread_and_z(segment(bars, rules.lookback, f.series_keys, reuse=True), rules, f)
    window, dof = rules.hmm
    df = hidden_states.hidden_regime(regime.spread_return(df, f), "spread_ret", window=window, dof=dof, f=f)
    return stage(trim(df).select(*bars.columns, "hmm_state"))


def fold_metrics(bars: DataFrame, runs: dict[str, S.Rules], bps: tuple[float, float] = (1.0, 2.0), f: Frame = FOLD_FRAME) -> DataFrame:
    """Backtest figures of every rule set over the test bars of every fold, each from a stake of one."""
    c, g = F.col, Frame(keys=("variant", *f.keys))
    out = None
    for name, rules in runs.items():
        df = S.generate(bars, rules, f=f, fit=c("use") == "train")
        df = df.select(*f.keys, OWN, "seg_off", "ts", "use", "fx_price", "comd_price", "spread_z", "signal", "fx_position", "comd_position", F.lit(name).alias("variant"))
        out = df if out is None else out.unionByName(df)
    keys = g.series_keys
    bt = B.run(out, *bps, f=g).filter("use = 'test'").select(*keys, "ts", "pnl", "delayed_signal", "trade_id")
    test = compound(segment(bt, 1, keys, reuse=True), 1.0 + c("pnl"), g)
    peak = F.greatest("peak", F.lit(1.0))
    test = stage(trim(test.withColumn("drawdown", R.clean(F.try_divide(c("equity") - peak, peak)))))
    # the first test bar's profit counts too, so returns are those of the last equity on the stake
    ends = test.groupBy(*keys).agg(F.max_by("equity", "ts").alias("_e1"), F.count(F.lit(1)).alias("_n"))
    m = B.metrics(test, keys=keys).drop("total_return", "annual_return").join(ends, list(keys))
    figures = {"total_return": c("_e1") - 1.0, "annual_return": B.cagr(F.lit(1.0), c("_e1"), c("_n"))}
    return m.withColumns(figures).drop("_e1", "_n")


KPIS = ("total_return", "annual_return", "sharpe_ratio", "max_drawdown", "win_rate", "profit_factor")


def compare(bars: DataFrame, runs: dict[str, S.Rules], years: dict[str, int], bps: tuple[float, float] = (1.0, 2.0)) -> DataFrame:
    """Out-of-sample figures of named rule sets over the folds of ``years`` (see :func:`assign_folds`): one row per pair and name.

    The signal plan runs over each fold's bars as a series of their own, with
    structural statistics from its training bars only; the test bars are
    scored.  Figures are medians over the folds with test bars, ``num_trades``
    their sum.  A rule set whose thresholds fail the checks of the backtest
    gives rows with the reason in ``error`` and no figures; the others still run.
    """
    failed: dict[str, str] = {}
    for name, rules in runs.items():
        try:
            B.check_thresholds(rules.entry_z, rules.exit_z, rules.stop_z)
        except ValueError as e:
            failed[name] = str(e)
    asked = [r for n, r in runs.items() if r.hmm and n not in failed]
    if asked and len({(r.hmm, r.beta_window, r.use_rls) for r in asked}) == 1:
        bars = with_states(bars, asked[0])
    folds = stage(marked_parts(assign_folds(bars, **years)))
    names = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(failed.get(n)).cast("string").alias("error")) for n in runs])
    rows = bars.select("pair").distinct().select("pair", F.explode(names).alias("_n")).select("pair", "_n.*")
    good = {n: r for n, r in runs.items() if n not in failed}
    if not good:
        return rows.withColumns({c: F.lit(None).cast("long") for c in ("folds", "num_trades")} | {k: F.lit(None).cast("double") for k in KPIS})
    medians = [F.percentile(k, F.lit(0.5)).alias(k) for k in KPIS]
    t = fold_metrics(folds, good, bps).groupBy("pair", "variant").agg(F.count(F.lit(1)).alias("folds"), F.sum("num_trades").alias("num_trades"), *medians)
    return rows.join(t, ["pair", "variant"], "left")
