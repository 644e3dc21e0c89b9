"""Market tables derived from the order, line-item and event tables.

Prices are exact means of cent amounts, so every engine starts from the same
doubles.  Cents are summed as whole numbers: exact, independent of the order,
and far cheaper than decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlake.sources import bars as B

PAIR_ROWS = [("A_N", "A", "N"), ("A_R", "A", "R"), ("N_R", "N", "R")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: str) -> Column:
    """Exact sum of non-negative two-decimal amounts."""
    return F.sum(F.floor(F.col(amount) * 100.0 + 0.5)) / F.lit(100.0)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean line price per return flag: ``symbol, ts, close``."""
    price = cents("l_extendedprice") / F.count(F.lit(1))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("symbol"), F.date_trunc("day", "l_shipdate").cast("timestamp").alias("ts"))
        .agg(price.alias("close"))
    )


def pair_list(spark: SparkSession) -> DataFrame:
    return named_pairs(spark, PAIR_ROWS)


def named_pairs(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A literal relation: its size is known to the optimizer."""
    values = ", ".join(f"('{p}', '{a}', '{b}')" for p, a, b in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(pair, fx_symbol, comd_symbol)")


def pair_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned daily pairs in price units the strategy expects."""
    return B.load_pairs(daily_bars(spark, sf_dir), pair_list(spark)).select(
        "pair", "ts", (F.col("fx_price") / 1e4).alias("fx_price"), (F.col("comd_price") / 1e3).alias("comd_price")
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is one tick of its type: ``pair, ts, event_id, price``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("pair"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price")
    )


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks in the one-price bar form that the hourly resampler takes."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), F.lit(1).cast("long").alias("volume"),
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.to_hourly(tick_bars(spark, sf_dir), F.struct("ts", "event_id"))


def hourly_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly aligned pairs of event types."""
    pairs = named_pairs(spark, [("click_view", "click", "view"), ("purchase_signup", "purchase", "signup")])
    return B.load_pairs(hourly_bars(spark, sf_dir), pairs)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value per day, in the range of a volatility index: ``pair, ts, vix``."""
    mean = cents("o_totalprice") / F.count(F.lit(1)) / 1e4
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp").alias("ts"))
        .agg(mean.alias("vix"))
        .select(F.lit("VIX").alias("pair"), "ts", "vix")
    )


def event_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First urgent order day of each month as a three-day event."""
    return (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .groupBy(F.date_trunc("month", "o_orderdate").alias("m"))
        .agg(F.min(F.to_date("o_orderdate")).alias("event_date"))
        .select("event_date", F.lit("INVENTORY_REPORT").alias("event_type"), F.lit(3).alias("impact_days"))
    )
