"""Rolling performance, return distributions, attribution and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlake.functions import rolling as R
from spreadlake.series import PAIR, Frame, join_small, segment, trim, with_series_stats
from spreadlake.session import stage

ANN = 252.0
WINDOWS = {"short": 30, "medium": 60, "long": 90}  # fixed values


def equity_frame(bt: DataFrame, window: int, f: Frame = PAIR) -> DataFrame:
    """Segmented equity with one-bar returns (0 on the first bar)."""
    df = segment(bt.select("pair", "ts", "equity"), window + 1)
    return df.withColumn("ret", F.coalesce(R.pct_change(F.col("equity"), 1, f), F.lit(0.0)))


def _ratio(mu: Column, sd: Column) -> Column:
    """Annualised mean over deviation, 0 without deviation, NULL while the frame fills."""
    return R.let(
        F.struct(mu.alias("m"), sd.alias("s")),
        lambda p: F.when(p["m"].isNull(), F.lit(None).cast("double"))
        .when(F.coalesce(p["s"], F.lit(0.0)) <= 1e-12, F.lit(0.0))
        .otherwise(p["m"] * ANN / (p["s"] * F.sqrt(F.lit(ANN)))),
    )


def rolling_sharpe(window: int, f: Frame = PAIR) -> Column:
    r = F.col("ret")
    return _ratio(R.mean(r, window, f), F.stddev_pop(r).over(f.last(window)))


def rolling_sortino(window: int, f: Frame = PAIR) -> Column:
    r = F.col("ret")
    return _ratio(R.mean(r, window, f), F.stddev_pop(F.when(r < 0, r)).over(f.last(window)))


def rolling_drawdown(window: int, f: Frame = PAIR) -> Column:
    return R.let(R.window_list(F.col("equity"), window, f), lambda v: F.when(v.isNotNull(), R.max_drawdown_of(v)))


def rolling_calmar(window: int, f: Frame = PAIR) -> Column:
    """Annualised mean return over the frame's drawdown; NULL where there is none to speak of."""
    dd = R.let(F.abs(rolling_drawdown(window, f)), lambda v: F.when(v > 1e-12, v))
    return R.mean(F.col("ret"), window, f) * ANN / dd


def rolling_win_rate(window: int, f: Frame = PAIR) -> Column:
    return R.mean((F.col("ret") > 0).cast("double"), window, f)


def rolling_metrics(bt: DataFrame, windows: dict[str, int] | None = None, f: Frame = PAIR) -> DataFrame:
    """Sharpe, Sortino and drawdown per named window; series shorter than a window get zeros."""
    windows = windows or WINDOWS
    df = equity_frame(bt, max(windows.values()), f)
    size = df.filter("own").groupBy(*f.series_keys).agg(F.count(F.lit(1)).alias("_n"))
    df = with_series_stats(df, size, f)
    out = {}
    for name, w in windows.items():
        short = F.col("_n") < w
        for label, c in (("sharpe", rolling_sharpe), ("sortino", rolling_sortino), ("drawdown", rolling_drawdown)):
            out[f"{label}_{name}"] = F.when(short, 0.0).otherwise(c(w, f))
    return trim(df.withColumns(out).drop("_n"))


#: Approximate quantiles that cut a series into buckets of about n / 256 values.
CUTS = 256


def quantiles(df: DataFrame, col: str, probs: dict[str, float], keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Exact interpolated quantiles per series, without all its values in one buffer or task.

    Sketched quantiles (a bounded number) cut each series into buckets; bucket
    counts place the wanted ranks, and only the buckets that hold one go on, as
    distinct values with their counts, so rows of one value are added up before
    they are shuffled.  Those buckets are cut and placed once more by their
    distinct values; a task orders about one in 65,536 of a series' distinct
    values.  Null and NaN values are left out.
    """
    x = F.col(col).cast("double")
    keys = list(keys)
    values = df.select(*keys, x.alias("_x"), F.lit(1).alias("_n")).filter(x.isNotNull() & ~F.isnan(x))
    rank = lambda p: (F.col("_all") - 1) * F.lit(p)

    def wanted(first: Column, n: Column) -> Column:
        """Whether one of the ranks lies among the ``n`` from ``first`` on."""
        holds = F.lit(False)
        for p in probs.values():
            for k in (F.floor(rank(p)), F.ceil(rank(p))):
                holds = holds | ((first <= k) & (k < first + n))
        return holds

    def narrowed(rows: DataFrame, bucket: str, on: list[str]) -> DataFrame:
        """The rows of the buckets that hold a wanted rank, with the bucket's first rank and the series' count."""
        known = [c for c in ("_before", "_all") if c in rows.columns]
        cuts = rows.groupBy(*on).agg(F.percentile_approx("_x", [i / CUTS for i in range(1, CUTS)], 10_000).alias("_cuts"))
        placed = join_small(rows, cuts, on).withColumn(bucket, F.size(F.filter("_cuts", lambda q: q < F.col("_x")))).drop("_cuts")
        counts = placed.groupBy(*on, *known, bucket).agg(F.sum("_n").alias("_held"))
        series = Window.partitionBy(*on)
        if not known:
            counts = counts.withColumns({"_before": F.lit(0), "_all": F.sum("_held").over(series)})
        counts = counts.withColumn("_before", F.col("_before") + F.sum("_held").over(series.orderBy(bucket)) - F.col("_held"))
        held = counts.filter(wanted(F.col("_before"), F.col("_held"))).select(*on, bucket, "_before", "_all")
        return join_small(placed.drop(*known), held, [*on, bucket])

    coarse = narrowed(values, "_b", keys)
    distinct = stage(coarse.groupBy(*keys, "_b", "_before", "_all", "_x").agg(F.sum("_n").alias("_n")))
    held = narrowed(distinct, "_c", [*keys, "_b"])
    line = Window.partitionBy(*keys, "_b", "_c").orderBy("_x")
    held = held.withColumn("_k", F.col("_before") + F.sum("_n").over(line) - F.col("_n"))
    at = lambda k: F.max(F.when((F.col("_k") <= k) & (k < F.col("_k") + F.col("_n")), F.col("_x")))
    parts = {name: F.struct(at(F.floor(rank(p))).alias("lo"), at(F.ceil(rank(p))).alias("hi"), F.max(rank(p) - F.floor(rank(p))).alias("f")) for name, p in probs.items()}
    found = held.groupBy(*keys).agg(*[part.alias(name) for name, part in parts.items()])
    return found.select(*keys, *[(F.col(n)["lo"] + (F.col(n)["hi"] - F.col(n)["lo"]) * F.col(n)["f"]).alias(n) for n in probs])


def distribution(df: DataFrame, ret: str, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Population skewness, excess kurtosis, value at risk and expected shortfall.

    The shortfall is a second pass joined on the one-row-per-series quantiles.
    """
    r = F.col(ret)
    q = df.groupBy(*keys).agg(
        F.count(r).alias("n"),
        F.when(F.count(r) >= 3, F.coalesce(R.clean(F.skewness(r)), F.lit(0.0))).otherwise(0.0).alias("skewness"),
        F.when(F.count(r) >= 4, F.coalesce(R.clean(F.kurtosis(r)), F.lit(0.0))).otherwise(0.0).alias("kurtosis"),
    ).join(quantiles(df, ret, {"var_95": 0.05, "var_99": 0.01}, keys), list(keys), "left")
    tail = (
        join_small(df.select(*keys, r.alias("_r")), q.select(*keys, "var_95", "var_99"), list(keys))
        .filter("_r <= var_95")
        .groupBy(*keys)
        .agg(F.avg("_r").alias("cvar_95"), F.avg(F.when(F.col("_r") <= F.col("var_99"), F.col("_r"))).alias("cvar_99"))
    )
    return q.join(tail, list(keys), "left")


def interpret(dist: DataFrame) -> DataFrame:
    """Reading of a distribution summary as text."""
    s, k = F.col("skewness"), F.col("kurtosis")
    # Wording and thresholds of the summary.
    parts = [
        F.when(s > 0.5, "Positive skewness: More large positive returns")
        .when(s < -0.5, "Negative skewness: More large negative returns")
        .otherwise("Approximately symmetric distribution"),
        F.when(k > 3, "Leptokurtic: Fat tails, more extreme values")
        .when(k < 3, "Platykurtic: Thin tails, fewer extreme values")
        .otherwise("Mesokurtic: Normal-like tail behavior"),
        F.when(F.col("var_95") < -0.02, "High VaR at 95% confidence: Significant tail risk"),
        F.when(F.col("var_99") < -0.05, "High VaR at 99% confidence: Extreme tail risk"),
    ]
    return dist.withColumn("distribution_interpretation", F.concat_ws("; ", *parts))


def rolling_distribution(df: DataFrame, ret: str, window: int, f: Frame = PAIR) -> DataFrame:
    """Skewness, excess kurtosis and 5% quantile over a frame."""
    r, w = F.col(ret), f.last(window)

    def quantile(v: Column) -> Column:
        at = 0.05 * (window - 1)
        lo, part = int(at), at - int(at)
        return R.let(
            F.sort_array(v), lambda s: F.element_at(s, lo + 1) * (1 - part) + F.element_at(s, min(lo + 2, window)) * part
        )

    return df.withColumns(
        {
            "roll_skew": R.clean(R.full(w, window, r, F.skewness(r))),
            "roll_kurt": R.clean(R.full(w, window, r, F.kurtosis(r))),
            "roll_var_95": R.let(R.window_list(r, window, f), lambda v: F.when(v.isNotNull(), quantile(v))),
        }
    )


def bucketed(bt: DataFrame, price: str = "fx_price", f: Frame = PAIR) -> DataFrame:
    """Bars labelled with two-year, trend and volatility buckets."""
    df = segment(bt, 22).withColumn("_r", R.pct_change(F.col(price), 1, f))
    y = F.floor(F.year("ts") / 2) * 2
    trend = F.try_divide(F.col(price), F.lag(price, 20).over(f.ordered())) - 1
    vol = R.std(F.col("_r"), 20, f) * F.sqrt(F.lit(ANN))
    df = df.withColumns(
        {
            "years": F.concat_ws("-", y.cast("string"), (y + 1).cast("string")),
            "trend": R.let(trend, lambda t: F.when(t > 0.02, "up").when(t < -0.02, "down").when(t.isNotNull(), "flat").otherwise("unknown")),
            "vol": R.let(vol, lambda v: F.when(v < 0.05, "low").when(v < 0.10, "medium").when(v.isNotNull(), "high").otherwise("unknown")),
        }
    )
    return trim(df.drop("_r"))


def attribution(labelled: DataFrame) -> DataFrame:
    """Return, trades and days per pair and bucket, all three bucketings in one pass."""
    c = F.col
    kind = F.when(F.grouping("years") == 0, "years").when(F.grouping("trend") == 0, "trend").otherwise("vol")
    sets = [[c("pair"), c("years")], [c("pair"), c("trend")], [c("pair"), c("vol")]]
    return labelled.groupingSets(sets, "pair", "years", "trend", "vol").agg(
        kind.alias("bucketing"),
        (F.try_divide(F.max_by("equity", "ts"), F.min_by("equity", "ts")) - 1).alias("bucket_return"),
        F.count_distinct(F.when(c("delayed_signal") != 0, c("trade_id"))).alias("trades"),
        F.count(F.lit(1)).alias("days"),
    ).select("pair", "bucketing", F.coalesce("years", "trend", "vol").alias("bucket"), "bucket_return", "trades", "days")


def across_pairs(attr: DataFrame) -> DataFrame:
    return attr.groupBy("bucketing", "bucket").agg(
        F.percentile("bucket_return", F.lit(0.5)).alias("median_return"),
        F.avg("bucket_return").alias("mean_return"),
        F.sum("trades").alias("trades"),
        F.count(F.lit(1)).alias("pairs"),
    )


def latest_reports(runs: DataFrame, order: str = "run_ts") -> DataFrame:
    """The newest metrics row per pair (an aggregate, so no pair is sorted in one task)."""
    cols = [c for c in runs.columns if c != "pair"]
    return runs.groupBy("pair").agg(F.max_by(F.struct(*cols), order).alias("r")).select("pair", "r.*")


def failure_flags(m: DataFrame) -> DataFrame:
    """Names of the failure modes each pair shows."""
    c = F.col
    # Failure-mode limits.
    rules = {
        "no_trades": c("num_trades") == 0, "negative_sharpe": c("sharpe_ratio") < 0,
        "deep_drawdown": c("max_drawdown") < -0.30, "low_win_rate": c("win_rate") < 0.40,
        "weak_profit_factor": c("profit_factor") < 1.1, "left_skew": c("skewness") < -1,
        "fat_tails": c("kurtosis") > 10, "large_var": c("var_95") < -0.05,
    }
    flags = F.array_compact(F.array(*[F.when(R.holds(v), F.lit(k)) for k, v in rules.items()]))
    return m.withColumn("failures", F.concat_ws(",", flags)).withColumn("n_failures", F.size(flags))


def value_shares(df: DataFrame, col: str, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Counts of a discrete column and their share per series."""
    n = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def strength_bins(df: DataFrame, x: str, y: str, bins: int = 10, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Mean of ``y`` per equal-width, right-closed bin of ``x`` (the first bin takes the minimum)."""
    lim = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    rows = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).filter("_x IS NOT NULL")
    # limits are one row per series; the bars are aggregated by value of x first, so no series is shuffled whole
    counted = rows.groupBy(*keys, "_x").agg(F.sum("_y").alias("_sum"), F.count("_y").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    b = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col("_x") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)).cast("int")))
    return (
        join_small(counted, lim, list(keys))
        .groupBy(*keys, b.alias("bin"))
        .agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean_y"), F.sum("_rows").alias("n"))
    )
