"""Loss limits, circuit breaker, position sizing and stress scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadlake.functions import rolling as R
from spreadlake.schemas import SCENARIOS
from spreadlake.series import OWN, Frame, compound, segment
from spreadlake.session import stage


@dataclass(frozen=True)
class Limits:
    """Default risk limits."""

    max_drawdown: float = 0.15
    daily_loss: float = 0.02
    weekly_loss: float = 0.05
    daily_drawdown: float = 0.02
    pair_size: float = 0.10
    total_exposure: float = 0.50
    trade_risk: float = 0.01
    cooldown_days: int = 1
    volatility_scaling: bool = True


def period_pnl(df: DataFrame, pnl: str = "pnl") -> DataFrame:
    """Running profit within the calendar day and week of each pair.

    Day and week partitions bound a task by what one pair trades in a week.
    """
    day = Window.partitionBy("pair", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    week = Window.partitionBy("pair", "week").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"day": F.to_date("ts"), "week": F.to_date(F.date_trunc("week", "ts"))})
    return df.withColumns({"daily_pnl": F.sum(pnl).over(day), "weekly_pnl": F.sum(pnl).over(week)})


def loss_flags(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Breaches per pair and, from per-bar totals over all pairs, for the account."""
    h = R.holds
    total_day = Window.partitionBy("day").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    total_week = Window.partitionBy("week").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    account = (
        df.groupBy("ts", "day", "week").agg(F.sum("pnl").alias("_p"))
        .withColumns({"account_daily": F.sum("_p").over(total_day), "account_weekly": F.sum("_p").over(total_week)})
        .drop("_p", "day", "week")
    )
    c = F.col
    return df.join(account, "ts").withColumns(
        {
            "drawdown_breach": h(c("drawdown") < -limits.max_drawdown),
            "daily_breach": h(c("daily_pnl") < -limits.daily_loss),
            "weekly_breach": h(c("weekly_pnl") < -limits.weekly_loss),
            "account_daily_breach": h(c("account_daily") < -limits.daily_loss),
            "account_weekly_breach": h(c("account_weekly") < -limits.weekly_loss),
        }
    )


def daily_drawdown(df: DataFrame, limit: float = 0.02) -> DataFrame:
    """Equity against the day's high so far."""
    day = Window.partitionBy("pair", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    high = F.max("equity").over(day)
    return df.withColumn("day_drawdown", F.try_divide(F.col("equity") - high, high)).withColumn(
        "day_drawdown_breach", R.holds(F.col("day_drawdown") < -limit)
    )


def circuit_breaker(df: DataFrame, trigger: Column, cooldown_days: int = 1) -> DataFrame:
    """Account-wide halt from each trigger date until ``cooldown_days`` later.

    Trigger dates are spread over the few days they block and joined on the day.
    """
    blocked = (
        df.filter(trigger).select(F.to_date("ts").alias("d")).distinct()
        .select(F.explode(F.sequence(F.lit(0), F.lit(cooldown_days - 1))).alias("k"), "d")
        .select(F.date_add("d", F.col("k")).alias("day")).distinct()
        .withColumn("breaker_active", F.lit(True))
    )
    df = df if "day" in df.columns else df.withColumn("day", F.to_date("ts"))
    return df.join(blocked, "day", "left").withColumn("breaker_active", F.coalesce("breaker_active", F.lit(False)))


def can_trade(df: DataFrame) -> DataFrame:
    c = F.col
    blocked = (
        c("breaker_active") | c("drawdown_breach") | c("daily_breach") | c("weekly_breach")
        | c("account_daily_breach") | c("account_weekly_breach") | c("day_drawdown_breach")
    )
    return df.withColumn("can_trade", ~blocked)


def exposure(df: DataFrame, equity: float, limit: float = 0.50) -> DataFrame:
    """Gross position value over all pairs per bar against account equity."""
    gross = F.abs(F.col("fx_position") * F.col("fx_price")) + F.abs(F.col("comd_position") * F.col("comd_price"))
    return df.groupBy("ts").agg((F.sum(gross) / equity).alias("exposure")).withColumn(
        "exposure_breach", R.holds(F.col("exposure") > limit)
    )


def position_size(df: DataFrame, equity: float, target: float = 0.01, limits: Limits = Limits()) -> DataFrame:
    """Leg sizes from ATR (or volatility), capped by pair value and by risk at the stop.

    Needs ``signal, fx_price, comd_price, fx_vol, comd_vol, fx_atr, comd_atr, stop_distance``.
    """
    c, zero = F.col, F.lit(0.0)

    def base(leg: str) -> Column:
        by_vol = F.when(c(f"{leg}_vol") > 0, F.try_divide(F.lit(target), c(f"{leg}_vol"))).otherwise(zero)
        return F.when(c(f"{leg}_atr") > 0, F.try_divide(F.lit(target), c(f"{leg}_atr"))).otherwise(by_vol)

    df = df.withColumns({"_f": base("fx") / c("fx_price"), "_c": base("comd")})
    if limits.volatility_scaling:
        top = F.greatest("fx_vol", "comd_vol")
        k = F.when(top > target, F.least(F.lit(1.0), F.try_divide(F.lit(target), top))).otherwise(1.0)
        df = df.withColumn("_k", k).withColumns({"_f": c("_f") * c("_k"), "_c": c("_c") * c("_k")})
    value = F.abs(c("_f") * c("fx_price")) + F.abs(c("_c") * c("comd_price"))
    cap = equity * limits.pair_size
    df = df.withColumn("_v", value).withColumn("_k", F.when(c("_v") > cap, cap / c("_v")).otherwise(1.0))
    df = df.withColumns({"_f": c("_f") * c("_k"), "_c": c("_c") * c("_k"), "_r": c("_v") * c("_k") * c("stop_distance")})
    allowed = equity * limits.trade_risk
    df = df.withColumn("_k", F.when((c("stop_distance") > 0) & (c("_r") > allowed), allowed / c("_r")).otherwise(1.0))
    flat = c("signal") == 0
    return df.withColumns(
        {
            "fx_order": F.when(flat, zero).otherwise(c("_f") * c("_k") * c("signal")),
            "comd_order": F.when(flat, zero).otherwise(-c("_c") * c("_k") * c("signal")),
        }
    ).drop("_f", "_c", "_k", "_v", "_r")


# --- stress -------------------------------------------------------------------------------------

# Name, drawdown and volatility multiples, correlation, duration in days.
DEFAULT_SCENARIOS = [
    ("Market Crash", 3.0, 2.5, 0.0, 60),
    ("Flash Crash", 5.0, 4.0, 0.0, 5),
    ("Correlation Breakdown", 1.0, 1.0, -0.5, 90),
    ("Volatility Spike", 1.0, 3.0, 0.0, 30),
    ("Prolonged Drawdown", 2.0, 1.0, 0.0, 180),
    ("Daily Drawdown Stress", 1.5, 1.0, 0.0, 10),
    ("High Volatility Regime", 1.0, 2.0, 0.0, 60),
]
STRESS_FRAME = Frame(keys=("pair", "name", "seg"))


def scenario_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*s, 1.0) for s in DEFAULT_SCENARIOS], SCENARIOS)


def stressed(bt: DataFrame, scenarios=DEFAULT_SCENARIOS, noise_seed: int | None = None, f: Frame = STRESS_FRAME) -> DataFrame:
    """Equity paths per scenario: losses amplified, then re-compounded from the first bar's equity.

    ``noise_seed`` adds the volatility scenarios' normal noise, derived from a
    hash of the row so that a repeated task gives the same path.
    """
    df = segment(bt.select("pair", "ts", "equity", "pnl"), 2)
    items = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(d).alias("dd_mult"), F.lit(v).alias("vol_mult")) for n, d, v, _, _ in scenarios]
    )
    df = df.withColumn("_s", F.explode(items)).select("*", "_s.*").drop("_s")
    ret = F.coalesce(R.pct_change(F.col("equity"), 1, f), F.lit(0.0))
    df = df.withColumn("_r", ret)
    hit = F.when((F.col("_r") < 0) & (F.col("dd_mult") > 1), F.col("_r") * F.col("dd_mult")).otherwise(F.col("_r"))
    first = F.col("seg_off") == 0
    start = F.when(first & F.lag("ts").over(f.ordered()).isNull(), F.col("equity")).otherwise(1.0)
    df = stage(df.withColumn("_g", (1.0 + hit) * start))
    df = compound(df, F.col("_g"), f, "stressed", "peak")
    if noise_seed is not None:
        u = lambda k: (F.pmod(F.xxhash64("pair", "ts", "name", F.lit(noise_seed + k)), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
        gauss = F.sqrt(-2.0 * F.ln(u(0))) * F.cos(u(1) * 6.283185307179586)
        bumped = F.col("stressed") * (1.0 + 0.01 * (F.col("vol_mult") - 1.0) * gauss)
        df = df.withColumn("stressed", F.when(F.col("vol_mult") > 1, bumped).otherwise(F.col("stressed")))
        df = compound_peak(df, f)
    return df.filter(OWN).withColumn("stressed_dd", F.try_divide(F.col("stressed") - F.col("peak"), F.col("peak")))


def compound_peak(df: DataFrame, f: Frame) -> DataFrame:
    """Running maximum of a known path, exact across segments."""
    from spreadlake.series import carried, prefix

    s = df.filter(OWN).groupBy(*f.keys).agg(F.max("stressed").alias("_m"))
    s = s.select(*f.keys, F.max("_m").over(prefix(f)).alias("_cm"))
    local = F.max(F.when(F.col(OWN), F.col("stressed"))).over(f.running())
    return carried(df, s, f).withColumn("peak", F.greatest(local, F.col("_cm"))).drop("_cm")


def stress_results(paths: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Worst drawdown, final equity and breaches per pair and scenario."""
    return paths.groupBy("pair", "name").agg(
        F.min("stressed_dd").alias("max_drawdown"),
        F.max_by("stressed", "ts").alias("final_equity"),
        F.count_if(F.col("stressed_dd") < -limits.max_drawdown).alias("violations"),
    )


def stress_verdict(results: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pass or fail; the daily-drawdown and volatility-regime scenarios have wider bounds."""
    c = F.col
    depth = F.when(c("name") == "Daily Drawdown Stress", 5 * limits.max_drawdown).otherwise(3 * limits.max_drawdown)
    room = F.when(c("name") == "High Volatility Regime", 5).otherwise(2)
    return results.withColumn(
        "passed", (F.abs("max_drawdown") <= depth) & (c("violations") <= room) & (c("final_equity") >= 0.5)
    )


def stress_report(results: DataFrame) -> DataFrame:
    line = F.format_string(
        "%s | max drawdown %.2f%% | final equity %.2f | violations %d",
        "name", R.rounded(F.col("max_drawdown") * 100, 2), R.rounded(F.col("final_equity"), 2), "violations",
    )
    return results.select("pair", "name", line.alias("line"))
