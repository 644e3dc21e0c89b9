"""Writers for signal, backtest and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlake.functions.rolling import rounded


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = ("pair",), mode: str = "errorifexists") -> None:
    """Partitioned by pair; rows of a hot pair stay spread over as many files as tasks hold them."""
    writer = df.write.mode(mode).partitionBy(*by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _line(label: str, pattern: str, col: str) -> Column:
    return F.concat(F.lit(f"{label}: "), F.format_string(pattern, F.coalesce(F.col(col).cast("double"), F.lit(0.0))))


def report_text(metrics: DataFrame) -> DataFrame:
    """One formatted report per metrics row."""
    pct = lambda c: rounded(F.col(c) * 100, 2)
    m = metrics.select("*", *[pct(c).alias(f"_{c}") for c in ("total_return", "annual_return", "max_drawdown", "win_rate")])
    lines = [
        F.concat(F.lit("Backtest report: "), F.col("pair")),
        _line("Total return (%)", "%.2f", "_total_return"),
        _line("Annual return (%)", "%.2f", "_annual_return"),
        _line("Sharpe ratio", "%.2f", "sharpe_ratio"),
        _line("Max drawdown (%)", "%.2f", "_max_drawdown"),
        _line("Trades", "%.0f", "num_trades"),
        _line("Win rate (%)", "%.2f", "_win_rate"),
        _line("Profit factor", "%.2f", "profit_factor"),
        _line("Days", "%.0f", "days_in_backtest"),
    ]
    return m.select("pair", F.concat_ws("\n", *lines).alias("report"))


def write_reports(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report_text(metrics).select("pair", F.col("report").alias("value")).write.mode(mode).partitionBy("pair").text(path)
