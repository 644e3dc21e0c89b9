"""One-bar-delayed profit and loss, equity, trades and per-pair metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlake.functions import costs
from spreadlake.functions import rolling as R
from spreadlake.schemas import SIGNAL_INPUT, require
from spreadlake.series import PAIR, Frame, compound, running_sum, segment, trim
from spreadlake.session import stage

BARS_PER_YEAR = 252


def check_inputs(df: DataFrame, entry_z: float, exit_z: float, stop_z: float) -> None:
    require(df, *SIGNAL_INPUT)
    check_thresholds(entry_z, exit_z, stop_z)


def check_thresholds(entry_z: float, exit_z: float, stop_z: float) -> None:
    if not stop_z > entry_z:
        raise ValueError("stop_z must be above entry_z")
    if not entry_z > exit_z:
        raise ValueError("entry_z must be above exit_z")


def delayed(df: DataFrame, f: Frame = PAIR) -> DataFrame:
    """Signals and positions act on the bar after the one that set them."""
    o = f.ordered()
    return df.withColumns(
        {
            "raw_signal": F.coalesce(F.col("signal").cast("double"), F.lit(0.0)),
            "delayed_fx_position": F.lag("fx_position").over(o),
            "delayed_comd_position": F.lag("comd_position").over(o),
        }
    ).withColumn("delayed_signal", F.lag("raw_signal").over(o))


def leg_pnl(df: DataFrame, f: Frame = PAIR) -> DataFrame:
    c = F.col
    df = df.withColumns(
        {
            "fx_return": R.pct_change(c("fx_price"), 1, f),
            "comd_return": R.pct_change(c("comd_price"), 1, f),
            "fx_pnl": c("delayed_fx_position") * R.diff(c("fx_price"), 1, f),
            "comd_pnl": c("delayed_comd_position") * R.diff(c("comd_price"), 1, f),
        }
    )
    return df.withColumn("gross_pnl", c("fx_pnl") + c("comd_pnl"))


def with_costs(df: DataFrame, fx_bps: float = 1.0, comd_bps: float = 2.0, policy: bool = False, f: Frame = PAIR) -> DataFrame:
    """Net profit per bar.

    Costs follow a signal change of exactly one, fall one bar late, and are
    charged on the position held (not its value); ``policy=True`` charges the
    full execution-cost model on the traded quantities instead.
    """
    o, c = f.ordered(), F.col
    df = df.withColumn("_flag", R.holds(F.abs(R.diff(c("delayed_signal"), 1, f)) == 1))
    if policy:
        traded = {
            leg: R.diff(F.coalesce(c(f"delayed_{leg}_position"), F.lit(0.0)), 1, f) for leg in ("fx", "comd")
        }
        cost = F.when(
            (traded["fx"] != 0) | (traded["comd"] != 0),
            costs.total_cost(c("fx_price"), c("comd_price"), traded["fx"], traded["comd"]),
        ).otherwise(0.0)
    else:
        late = F.lag(c("_flag").cast("double")).over(o)
        cost = late * (fx_bps / 1e4) * F.abs(c("delayed_fx_position")) + late * (comd_bps / 1e4) * F.abs(
            c("delayed_comd_position")
        )
    df = df.withColumn("cost", cost)
    return df.withColumn("pnl", F.coalesce(c("gross_pnl") - c("cost"), F.lit(0.0)))


def run(signals: DataFrame, fx_bps: float = 1.0, comd_bps: float = 2.0, policy: bool = False, f: Frame = PAIR) -> DataFrame:
    """Backtest frame, one row per bar, from segmented signals; the costs may be columns."""
    require(signals, *SIGNAL_INPUT)
    df = with_costs(leg_pnl(delayed(signals, f), f), fx_bps, comd_bps, policy, f)
    moved = ~R.holds(R.diff(F.col("delayed_signal"), 1, f) == 0)
    df = stage(df.withColumn("_moved", moved.cast("int")))
    df = compound(df, 1.0 + F.col("pnl"), f)
    df = running_sum(df, {"cumulative_pnl": F.col("pnl"), "trade_id": F.col("_moved").cast("long")}, f)
    fall = R.clean(F.try_divide(F.col("equity") - F.col("peak"), F.col("peak")))
    return trim(df.withColumn("drawdown", F.coalesce(fall, F.lit(0.0))).drop("_moved", "peak"))


def from_table(signals: DataFrame, **kwargs) -> DataFrame:
    """Backtest a stored signal table (one row per bar)."""
    return run(segment(signals, 8), **kwargs)


def trades(bt: DataFrame, compat: bool = False) -> DataFrame:
    """One row per held stretch.

    ``compat`` also keeps the stretch made by each series' first bar, whose
    delayed signal is missing.
    """
    c = F.col
    held = (c("delayed_signal").isNull() | (c("delayed_signal") != 0)) if compat else (c("delayed_signal") != 0)
    first, last = (lambda x: F.min_by(x, "ts")), (lambda x: F.max_by(x, "ts"))
    t = (
        bt.filter(held)
        .groupBy("pair", "trade_id")
        .agg(
            F.min("ts").alias("entry_date"), F.max("ts").alias("exit_date"),
            F.max(c("delayed_signal")).cast("int").alias("direction"),
            F.count(F.lit(1)).alias("duration"), F.sum("pnl").alias("pnl"),
            first("fx_price").alias("fx_entry"), last("fx_price").alias("fx_exit"),
            first("comd_price").alias("comd_entry"), last("comd_price").alias("comd_exit"),
            first("spread_z").alias("entry_z"), last("spread_z").alias("exit_z"),
        )
    )
    return t.withColumn("return", F.try_divide(c("pnl"), F.abs("fx_entry") + F.abs("comd_entry")))


def with_trade_stats(bt: DataFrame) -> DataFrame:
    """Trade totals repeated on the bars of each trade, 0 elsewhere.

    The join key carries the month, so a stretch that lasts for years (held or
    flat) is spread over many tasks.
    """
    month = F.date_trunc("month", "ts")
    held = bt.filter(F.col("delayed_signal") != 0).groupBy("pair", "trade_id", month.alias("_month")).agg(F.count(F.lit(1)).alias("_n"))
    t = trades(bt).select("pair", "trade_id", F.col("pnl").alias("trade_pnl"), F.col("return").alias("trade_return"))
    parts = held.drop("_n").join(t, ["pair", "trade_id"])
    out = bt.withColumn("_month", month).join(parts, ["pair", "trade_id", "_month"], "left").drop("_month")
    return out.fillna(0.0, ["trade_pnl", "trade_return"])


def sharpe(ret: str) -> Column:
    sd = F.stddev_pop(ret)
    return F.when(sd <= 1e-12, F.lit(0.0)).otherwise(F.avg(ret) * BARS_PER_YEAR / (sd * F.sqrt(F.lit(float(BARS_PER_YEAR)))))


def cagr(first: Column, last: Column, bars: Column) -> Column:
    """Zero without a positive start or a second bar; NULL when the end-to-start ratio is not positive."""
    ratio = F.try_divide(last, first)
    return F.when((bars < 2) | (first <= 0), 0.0).when(ratio > 0, F.pow(ratio, BARS_PER_YEAR / bars) - 1)


def metrics(bt: DataFrame, compat: bool = False, min_trades: int = 0, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """The twelve headline figures per pair."""
    c = F.col
    moved = F.abs(c("delayed_signal") - c("_prev")) == 1
    # a change of the delayed signal is visible in trade ids, so no window is needed here:
    # runs are consecutive, and each run's signal is constant
    runs = bt.groupBy(*keys, "trade_id").agg(
        F.max("delayed_signal").alias("s"), F.sum("pnl").alias("run_pnl")
    )
    prior = runs.select(*keys, (c("trade_id") + 1).alias("trade_id"), c("s").alias("_prev"))
    runs = runs.withColumnRenamed("s", "delayed_signal").join(prior, [*keys, "trade_id"], "left")
    held = (c("delayed_signal").isNull() | (c("delayed_signal") != 0)) if compat else (c("delayed_signal") != 0)
    win, loss = held & (c("run_pnl") > 0), held & (c("run_pnl") < 0)
    t = runs.groupBy(*keys).agg(
        F.floor(F.count_if(moved) / 2).cast("long").alias("num_trades"),
        F.count_if(held).alias("_held"), F.count_if(win).alias("_wins"), F.count_if(loss).alias("_losses"),
        F.avg(F.when(win, c("run_pnl"))).alias("_aw"), F.avg(F.when(loss, c("run_pnl"))).alias("_al"),
        F.sum(F.when(win, c("run_pnl"))).alias("_sw"), F.sum(F.when(loss, c("run_pnl"))).alias("_sl"),
    )
    b = bt.groupBy(*keys).agg(
        F.sum("pnl").alias("total_pnl"), F.min_by("equity", "ts").alias("_e0"), F.max_by("equity", "ts").alias("_e1"),
        F.min("drawdown").alias("max_drawdown"), (F.stddev_samp("pnl") * F.sqrt(F.lit(252.0))).alias("volatility"),
        sharpe("pnl").alias("sharpe_ratio"), F.count(F.lit(1)).alias("_n"),
        F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("days_in_backtest"),
    )
    traded = c("num_trades") > 0
    zero = F.lit(0.0)
    factor = (
        F.when(c("_losses") > 0, F.abs(F.coalesce(c("_sw"), zero) / c("_sl"))).when(c("_wins") > 0, 999.0).otherwise(0.0)
    )
    enough = c("num_trades") >= min_trades
    return b.join(t, list(keys)).select(
        *keys, "total_pnl", (F.try_divide(c("_e1"), c("_e0")) - 1).alias("total_return"),
        F.when(enough, cagr(c("_e0"), c("_e1"), c("_n"))).otherwise(0.0).alias("annual_return"),
        "max_drawdown", "volatility",
        F.when(enough, c("sharpe_ratio")).otherwise(0.0).alias("sharpe_ratio"),
        "num_trades",
        F.when(traded, F.coalesce(F.try_divide(c("_wins"), c("_held")), zero)).otherwise(0.0).alias("win_rate"),
        F.when(traded, F.coalesce(c("_aw"), zero)).otherwise(0.0).alias("avg_win"),
        F.when(traded, F.coalesce(c("_al"), zero)).otherwise(0.0).alias("avg_loss"),
        F.when(traded, factor).otherwise(0.0).alias("profit_factor"), "days_in_backtest",
    )
