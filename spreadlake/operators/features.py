"""Feature and label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlake.functions import rolling as R
from spreadlake.series import PAIR, Frame

# Moving-window sets of the three strategy variants.
WINDOW_SETS = {"base": (5, 10, 20, 60), "d1": (20, 60, 120, 252), "h1": (4, 8, 16, 24)}


def strategy_features(df: DataFrame, windows: tuple[int, ...] = WINDOW_SETS["base"], f: Frame = PAIR) -> DataFrame:
    """Returns, rolling deviations and means of both legs beside spread columns; incomplete rows dropped."""
    df = df.withColumns(
        {"fx_returns": R.pct_change(F.col("fx_price"), 1, f), "comd_returns": R.pct_change(F.col("comd_price"), 1, f)}
    )
    cols: dict[str, Column] = {}
    for n in windows:
        for leg in ("fx", "comd"):
            cols[f"{leg}_vol_{n}"] = R.std(F.col(f"{leg}_returns"), n, f)
            cols[f"{leg}_ma_{n}"] = R.mean(F.col(f"{leg}_price"), n, f)
    return df.withColumns(cols).dropna()


def filter_features(df: DataFrame, lags: tuple[int, ...] = (1, 2, 3, 5), periods: tuple[int, ...] = (5, 10, 20), f: Frame = PAIR) -> DataFrame:
    """Features of the signal filter: z lags, spread statistics, calendar parts, returns and volatility."""
    o = f.ordered()
    cols: dict[str, Column] = {f"z_lag_{k}": F.lag("spread_z", k).over(o) for k in lags}
    for n in periods:
        cols[f"spread_mean_{n}"] = R.mean(F.col("spread"), n, f)
        cols[f"spread_std_{n}"] = R.std(F.col("spread"), n, f)
    cols["day_of_week"] = F.weekday("ts")
    cols["month"] = F.month("ts")
    cols["fx_returns"] = R.pct_change(F.col("fx_price"), 1, f)
    cols["comd_returns"] = R.pct_change(F.col("comd_price"), 1, f)
    df = df.withColumns(cols)
    return df.withColumns(
        {"fx_volatility": R.std(F.col("fx_returns"), 20, f), "comd_volatility": R.std(F.col("comd_returns"), 20, f)}
    ).dropna()


def forward_labels(df: DataFrame, bars: int = 5, threshold: float = 0.0, f: Frame = PAIR) -> DataFrame:
    """1 when the spread gains more than ``threshold`` over the next bars; unknown at the end.

    Written as a backward return moved to the bar where it starts, so the label
    row carries the bar's own time (``label_ts``) and the halo needs only past bars.
    """
    o = f.ordered()
    gain = R.pct_change(F.col("spread"), bars, f)
    return df.select(
        *f.keys, "own", F.lag("ts", bars).over(o).alias("label_ts"), F.col("ts").alias("label_end"), gain.alias("forward_return"), R.diff(F.col("spread"), bars, f).alias("forward_change")
    ).filter("label_ts IS NOT NULL").withColumn(
        "label", F.when(F.col("forward_return").isNotNull(), (F.col("forward_return") > threshold).cast("int"))
    )


def trade_labels(trades: DataFrame) -> DataFrame:
    """One label per trade at its exit bar with the window it was decided in."""
    r = F.col("return") * F.signum("direction")
    return trades.select(
        "pair", "trade_id", F.col("exit_date").alias("ts"), F.col("entry_date").alias("label_start"),
        F.col("exit_date").alias("label_end"), F.col("return").alias("trade_return"),
        F.when(F.col("return") > 0, 1).otherwise(0).alias("label"), r.alias("signed_return"),
    )
