"""Data-quality and configuration checks as DataFrame reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlake.functions import rolling as R
from spreadlake.series import PAIR, Frame

# Parameter ranges by module; no upper bound is infinity.
RULES = [
    ("signal_generation", "entry_z", 0.1, 5.0),
    ("signal_generation", "exit_z", 0.0, 2.0),
    ("signal_generation", "stop_z", 1.0, 10.0),
    ("signal_generation", "beta_window", 10.0, 500.0),
    ("signal_generation", "z_window", 5.0, 200.0),
    ("backtest", "entry_z", 0.1, 5.0),
    ("backtest", "exit_z", 0.0, 2.0),
    ("backtest", "stop_z", 1.0, 10.0),
    ("backtest", "max_bars", 1.0, 1000.0),
    ("risk_management", "max_position_pct", 0.001, 1.0),
    ("risk_management", "max_daily_loss_pct", 0.001, 0.5),
    ("risk_management", "max_drawdown_pct", 0.01, 0.9),
    ("risk_management", "position_size", 0.0, float("inf")),
    ("feature_calculation", "window", 2.0, 1000.0),
    ("feature_calculation", "atr_window", 5.0, 100.0),
    ("feature_calculation", "corr_window", 5.0, 500.0),
    ("feature_calculation", "min_abs_corr", 0.0, 1.0),
]
# Required keys of a configuration's sections, and the ranges of those that have one.
REQUIRED = {
    "lookbacks": {"beta_window": (10.0, 500.0), "z_window": (5.0, 200.0), "corr_window": (5.0, 500.0)},
    "thresholds": {"entry_z": (0.1, 5.0), "exit_z": (0.0, 2.0), "stop_z": (1.0, 10.0)},
    "sizing": {"target_vol_per_leg": (0.001, 0.1), "atr_window": (5.0, 100.0)},
    "regime": {"min_abs_corr": (0.0, 1.0)},
}


def config_violations(spark: SparkSession, sections: dict[str, dict]) -> DataFrame:
    """Missing sections and keys, and values out of range, of nested pair sections: ``pair, path, problem``."""
    rows = []
    for pair, section in sections.items():
        for name, keys in REQUIRED.items():
            held = section.get(name)
            if not isinstance(held, dict):
                rows.append((pair, name, "section missing"))
                continue
            for key, (lo, hi) in keys.items():
                if key not in held:
                    rows.append((pair, f"{name}.{key}", "key missing"))
                elif not lo <= float(held[key]) <= hi:
                    rows.append((pair, f"{name}.{key}", f"not in [{lo:g}, {hi:g}]"))
    return spark.createDataFrame(rows, "pair string, path string, problem string")


def series_report(df: DataFrame, col: str, min_length: int, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Length, missing, non-finite and non-positive counts in one pass."""
    x = F.col(col)
    r = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(x.isNull()).alias("n_null"),
        F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("n_not_finite"),
        F.count_if(x <= 0).alias("n_not_positive"),
        F.min(x).alias("min_value"),
        F.max(x).alias("max_value"),
    )
    ok = (F.col("n") >= min_length) & (F.col("n_null") == 0) & (F.col("n_not_finite") == 0)
    return r.withColumn("valid", ok)


def range_report(df: DataFrame, col: str, lo: float, hi: float, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    x = F.col(col)
    return df.groupBy(*keys).agg(
        F.count_if((x < lo) | (x > hi)).alias("out_of_range"), F.count_if(R.holds((x >= 0) & (x <= 1))).alias("probability_like")
    )


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "module string, param string, lo double, hi double")


def params_report(params: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (pair, parameter) against the rule registry, plus the threshold order."""
    names = list(dict.fromkeys(r[1] for r in RULES))
    have = [n for n in names if n in params.columns]
    long = params.select("pair", *[F.col(c).cast("double").alias(c) for c in have]).unpivot("pair", have, "param", "value")
    return long.join(rules, "param").select(
        "pair", "module", "param", "value", R.holds(F.col("value").between(F.col("lo"), F.col("hi"))).alias("valid")
    )


def threshold_order(params: DataFrame) -> DataFrame:
    return params.withColumn("ordered", R.holds((F.col("stop_z") > F.col("entry_z")) & (F.col("entry_z") > F.col("exit_z"))))


def alignment_report(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Length difference and share of common bars of two series sets, by one tagged union and aggregate."""
    t = lambda d, s: d.select(*keys, "ts", F.lit(s).alias("_s"))
    per = t(a, 1).unionByName(t(b, 2)).groupBy(*keys, "ts").agg(F.bit_or("_s").alias("m"))
    r = per.groupBy(*keys).agg(
        F.count_if(F.col("m").bitwiseAND(1) > 0).alias("n_a"),
        F.count_if(F.col("m").bitwiseAND(2) > 0).alias("n_b"),
        F.count_if(F.col("m") == 3).alias("n_common"),
    )
    longest = F.greatest("n_a", "n_b")
    r = r.withColumn("overlap", F.try_divide(F.col("n_common"), F.least("n_a", "n_b")))
    ok = (F.abs(F.col("n_a") - F.col("n_b")) <= F.greatest(F.lit(10), longest * 0.01)) & (F.col("overlap") >= 0.8)
    return r.withColumn("aligned", R.holds(ok))


def spacing_report(df: DataFrame, f: Frame = PAIR) -> DataFrame:
    """Largest gap, duplicate times and share of one-day steps, from segmented bars."""
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(f.ordered()))
    d = df.withColumn("_g", gap).filter("own")
    return d.groupBy(*f.series_keys).agg(
        (F.max("_g") / 86_400_000_000).alias("max_gap_days"),
        F.count_if(F.col("_g") == 0).alias("duplicate_ts"),
        F.avg((F.col("_g") == 86_400_000_000).cast("double")).alias("daily_share"),
    )


def correlations(df: DataFrame, cols: list[str], keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Pairwise correlations as rows; one aggregate computes them all."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.groupBy(*keys).agg(*[F.expr(f"covar_pop(`{a}`, `{b}`) / nullif(stddev_pop(`{a}`) * stddev_pop(`{b}`), 0D)").alias(f"{a}|{b}") for a, b in pairs])
    entry = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("corr")) for a, b in pairs]
    return wide.select(*keys, F.explode(F.array(*entry)).alias("e")).select(*keys, "e.*")
