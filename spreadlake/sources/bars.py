"""Loading, aligning and resampling price bars held in files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlake.schemas import BARS
from spreadlake.series import Frame, forward_fill, segment, trim

SYMBOL = Frame(keys=("symbol", "seg"))
ENERGY_COMMODITIES = ("WTI", "Brent", "NaturalGas", "HeatingOil", "Gasoline")  # fixed values


def check_range(symbol: str | None, start: str, end: str) -> None:
    """Arguments of a load: ISO dates, start before end, non-empty symbol."""
    if symbol is not None and not symbol.strip():
        raise ValueError("symbol must not be empty")
    try:
        lo, hi = (datetime.strptime(d, "%Y-%m-%d") for d in (start, end))
    except ValueError as exc:
        raise ValueError("dates must be written YYYY-MM-DD") from exc
    if lo >= hi:
        raise ValueError("start must be before end")


def parsed_dates(df: DataFrame, column: str, out: str = "ts") -> DataFrame:
    """Text dates to timestamps; malformed text becomes NULL instead of failing the job."""
    return df.withColumn(out, F.try_to_timestamp(F.col(column), F.lit("yyyy-MM-dd")))


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars from files; text formats use the declared schema, never inference."""
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        reader = reader.schema(BARS)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def between(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows in ``[start, end)``; a plain comparison, so it reaches the scan."""
    check_range(None, start, end)
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))


def daily_closes(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Closes in a date range with gaps carried forward per symbol."""
    rows = between(bars, start, end).select("symbol", "ts", "close")
    filled = forward_fill(segment(rows, 1, keys=("symbol",)), ["close"], SYMBOL)
    return trim(filled).filter(F.col("close").isNotNull())


def align(fx: DataFrame, comd: DataFrame, keys: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Rows present on both sides with both prices known."""
    joined = fx.join(comd, list(keys), "inner")
    return joined.dropna()


def load_pairs(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs at once: ``pairs`` names two symbols, ``bars`` holds their closes.

    The list of pairs is unpivoted to (symbol, pair, leg), so the bars are read
    once and meet by ``(pair, ts)`` in one map-side-combined aggregate instead
    of a self-join.  Bars are unique per symbol and time.
    """
    legs = pairs.select(
        "pair",
        F.explode(
            F.array(
                F.struct(F.col("fx_symbol").alias("symbol"), F.lit(0).alias("leg")),
                F.struct(F.col("comd_symbol").alias("symbol"), F.lit(1).alias("leg")),
            )
        ).alias("l"),
    ).select("pair", "l.*")
    price = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("close")))
    return (
        bars.select("symbol", "ts", "close")
        .join(legs, "symbol")
        .groupBy("pair", "ts")
        .agg(price(0).alias("fx_price"), price(1).alias("comd_price"))
        .filter("fx_price IS NOT NULL AND comd_price IS NOT NULL")
    )


def to_hourly(ticks: DataFrame, order: Column | None = None) -> DataFrame:
    """Hourly OHLCV from finer bars or ticks (``symbol, ts, open, high, low, close, volume``)."""
    o = order if order is not None else F.col("ts")
    return ticks.groupBy("symbol", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.min_by("open", o).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", o).alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("hour", "ts")


def to_hourly_grid(daily: DataFrame) -> DataFrame:
    """Daily closes on an hourly grid, linear between closes, flat after the last one.

    Each bar emits only the hours up to the next bar, so no series-long grid
    is ever built or joined.
    """
    rows = segment(daily.select("symbol", "ts", "close"), 2, keys=("symbol",))
    n = SYMBOL.ordered()
    # The next bar of a segment's last row lives in the following segment, so
    # interpolation runs backwards from each bar to its predecessor instead.
    steps = (
        rows.withColumn("_prev_ts", F.lag("ts").over(n))
        .withColumn("_prev", F.lag("close").over(n))
        .filter("own")
    )
    inner = (
        steps.filter(F.col("_prev_ts").isNotNull())
        .withColumn("h", F.explode(F.sequence(F.col("_prev_ts"), F.col("ts") - F.expr("interval 1 hour"), F.expr("interval 1 hour"))))
        .withColumn(
            "w",
            (F.unix_micros("h") - F.unix_micros("_prev_ts")) / (F.unix_micros("ts") - F.unix_micros("_prev_ts")),
        )
        .select("symbol", F.col("h").alias("ts"), (F.col("_prev") + (F.col("close") - F.col("_prev")) * F.col("w")).alias("close"))
    )
    last = rows.filter("own").groupBy("symbol").agg(F.max("ts").alias("t"), F.max_by("close", "ts").alias("close"))
    tail = last.select(
        "symbol",
        F.explode(F.sequence(F.col("t"), F.col("t") + F.expr("interval 1 day"), F.expr("interval 1 hour"))).alias("ts"),
        "close",
    )
    c = F.col("close")
    return inner.unionByName(tail).select(
        "symbol", "ts", c.alias("open"), c.alias("high"), c.alias("low"), c, F.lit(0).cast("long").alias("volume")
    )


def conform(df: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """The seven bar columns in order, absent ones NULL, local times moved to UTC."""
    have = set(df.columns)
    cols = []
    for field in BARS.fields:
        if field.name == "symbol":
            continue
        if field.name == "ts":
            cols.append(F.to_utc_timestamp("ts", zone).alias("ts"))
        elif field.name in have:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    keys = [F.col("symbol")] if "symbol" in have else []
    return df.select(*keys, *cols)


def violations(bars: DataFrame) -> DataFrame:
    """Counts of broken bars per symbol."""
    bad = lambda c: F.count_if(c)
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        bad(F.col("ts").isNull()).alias("missing_ts"),
        bad(F.col("low") > F.col("high")).alias("low_above_high"),
        bad(F.col("volume") < 0).alias("negative_volume"),
        bad(F.col("close").isNull() | F.isnan("close")).alias("missing_close"),
    )


def energy(df: DataFrame, commodity: str, start: str, end: str) -> DataFrame:
    """One commodity's price rows in an inclusive date range."""
    if commodity not in ENERGY_COMMODITIES:
        raise ValueError(f"unknown commodity {commodity}")
    check_range(commodity, start, end)
    return df.filter(
        (F.col("commodity_type") == commodity) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )
