"""Stationarity and mean-reversion statistics, one row per series.

All of them are moment sums over lagged columns: lags come from segment
windows, the sums are ordinary map-side-combined aggregates, so a hot series
adds work to every task instead of to one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlake.functions.rolling import normal_cdf_sql
from spreadlake.series import OWN, PAIR, Frame, position, with_series_stats


def mackinnon_p(t: str) -> Column:
    """Approximate p-value of a unit-root t statistic (constant, one series)."""
    # MacKinnon (1994) response surface.
    low = "2.1659D + 1.4412D * u + 0.038269D * u * u"
    high = "1.7339D + 0.93202D * u - 0.12745D * u * u - 0.010368D * u * u * u"
    arg = normal_cdf_sql(f"CASE WHEN u <= -1.61D THEN {low} ELSE {high} END")
    return F.expr(
        f"element_at(transform(array({t}), u -> CASE WHEN u > 2.74D THEN 1D WHEN u < -18.83D THEN 0D ELSE {arg} END), 1)"
    )


def unit_root_test(df: DataFrame, col: str = "spread", f: Frame = PAIR, least: int = 10) -> DataFrame:
    """Augmented Dickey-Fuller test with zero or one lagged difference, chosen by AIC.

    Two-regressor least squares has a closed form in the six central moments,
    so the whole test is one aggregation and one projection.
    """
    keys = list(f.series_keys)
    lagged = df.filter(F.col(col).isNotNull()).selectExpr(
        *[f"`{k}`" for k in f.keys], OWN, f"`{col}` AS s",
        f"lag(`{col}`, 1) OVER ({f.sql}) AS a", f"lag(`{col}`, 2) OVER ({f.sql}) AS a2",
    )
    moves = lagged.filter(OWN).selectExpr(*[f"`{k}`" for k in keys], "s", "a", "s - a AS y", "a - a2 AS b")
    on2 = "FILTER (WHERE b IS NOT NULL)"
    m = moves.groupBy(*keys).agg(
        *[
            F.expr(e)
            for e in (
                "count(s) AS n_obs", "count(y) AS n0", "var_pop(a) AS aa0", "var_pop(y) AS yy0", "covar_pop(y, a) AS ya0",
                "count(b) AS n1", f"var_pop(a) {on2} AS aa", "var_pop(b) AS bb", f"var_pop(y) {on2} AS yy",
                f"covar_pop(a, b) {on2} AS ab", f"covar_pop(y, a) {on2} AS ya", f"covar_pop(y, b) {on2} AS yb",
            )
        ]
    )
    m = m.selectExpr("*", "aa * bb - ab * ab AS det", "try_divide(ya0, aa0) AS k0")
    m = m.selectExpr("*", "try_divide(ya * bb - yb * ab, det) AS k", "try_divide(yb * aa - ya * ab, det) AS g")
    m = m.selectExpr("*", "yy - k * ya - g * yb AS r1", "yy - try_divide(ya * ya, aa) AS r0", "yy0 - k0 * ya0 AS r00")
    one = "n1 * ln(r1) + 2 < n1 * ln(r0)"
    m = m.selectExpr(
        "*", f"CASE WHEN {one} THEN 1 ELSE 0 END AS used_lag",
        f"""CASE WHEN {one} THEN try_divide(k, sqrt(try_divide(r1, n1 - 3) * try_divide(bb, det)))
        ELSE try_divide(k0, sqrt(try_divide(try_divide(r00, aa0), n0 - 2))) END AS adf_stat""",
    )
    p = F.when((F.col("n_obs") >= least) & F.col("adf_stat").isNotNull(), mackinnon_p("adf_stat")).otherwise(F.lit(1.0))
    return m.select(*keys, "n_obs", "used_lag", "adf_stat", p.alias("adf_p"))


def default_max_lag(n: int) -> int:
    """Schwert's rule, limited so that the regression keeps degrees of freedom."""
    return max(0, min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25)))


def _gram(keys: int):
    """Cross-product sums of one segment for the lagged-difference regression."""

    def run(table: pa.Table) -> pa.Table:
        key_cols = table.column_names[:keys]
        order = np.argsort(table["pos"].to_numpy(), kind="stable")
        s = table["s"].to_numpy()[order]
        own = table["own"].to_numpy(zero_copy_only=False)[order]
        pos = table["pos"].to_numpy()[order]
        cap = int(table["max_lag"][0].as_py())
        d = np.diff(s)
        # design for bar t (index into s): const, s[t-1], d[t-1] .. d[t-cap]; response d[t]
        t = np.flatnonzero(own & (np.arange(len(s)) > 0))
        width = cap + 3
        out = []
        for full in (True, False):
            use = t[pos[t] > (cap + 1 if full else 1)]
            x = np.zeros((len(use), width))
            x[:, 0], x[:, 1], x[:, 2] = d[use - 1], 1.0, s[use - 1]
            for j in range(1, cap + 1):
                at = use - 1 - j
                x[:, 2 + j] = np.where(at >= 0, d[np.maximum(at, 0)], 0.0)
            if full:
                out.append((True, x.T @ x, len(use)))
            else:
                # rows near the series start, needed when fewer lags are used
                early = use[pos[use] <= cap + 1]
                for row, p in zip(x[np.isin(use, early)], pos[early]):
                    out.append((False, np.outer(row, row), int(p)))
        n = len(out)
        cols = {c: pa.array([table[c][0].as_py()] * n, table.schema.field(c).type) for c in key_cols}
        return pa.table(
            cols
            | {
                "bulk": pa.array([o[0] for o in out], pa.bool_()),
                "at": pa.array([o[2] for o in out], pa.int64()),
                "gram": pa.array([o[1].ravel().tolist() for o in out], pa.list_(pa.float64())),
            }
        )

    return run


def _pick_lag(gram: np.ndarray, rows: int, early: list[tuple[int, np.ndarray]], cap: int) -> tuple[int, float]:
    def fit(g: np.ndarray, n: int, lags: int):
        idx = slice(1, 3 + lags)
        xx, xy, yy = g[idx, idx], g[idx, 0], g[0, 0]
        inv = np.linalg.pinv(xx)
        b = inv @ xy
        rss = yy - b @ xy
        return b, inv, rss

    best = min(range(cap + 1), key=lambda k: rows * math.log(max(fit(gram, rows, k)[2], 1e-300) / rows) + 2 * (k + 2))
    extra = [g for p, g in early if best + 1 < p <= cap + 1]
    g = gram + sum(extra) if extra else gram
    n = rows + len(extra)
    b, inv, rss = fit(g, n, best)
    return best, float(b[1] / math.sqrt(rss / (n - best - 2) * inv[1, 1]))


def unit_root_test_auto(df: DataFrame, col: str = "spread", f: Frame = PAIR, max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with the lag order chosen by AIC up to Schwert's bound.

    Each segment contributes one small cross-product matrix; the matrices are
    summed per series and only their sum is solved.  The input's halo must
    cover ``max_lag + 1`` bars.
    """
    off, row = position(f)
    keys = list(f.keys)
    s = df.select(*keys, *f.order, OWN, "seg_off", F.col(col).alias("s")).filter("s IS NOT NULL")
    s = s.withColumn("pos", off + row)
    size = s.filter(OWN).groupBy(*f.series_keys).agg(F.count("s").alias("n_obs"), F.avg("s").alias("m"))
    if max_lag is None:
        rule = F.least(F.floor(F.col("n_obs") / 2) - 2, F.ceil(12.0 * F.pow(F.col("n_obs") / 100.0, F.lit(0.25))))
        size = size.withColumn("max_lag", F.greatest(F.lit(0), rule).cast("int"))
    else:
        size = size.withColumn("max_lag", F.lit(max_lag))
    rows = with_series_stats(s, size, f).filter("n_obs >= 10").select(
        *keys, "pos", (F.col("s") - F.col("m")).alias("s"), OWN, "max_lag"
    )
    schema = T.StructType([df.schema[k] for k in keys])
    schema = schema.add("bulk", T.BooleanType()).add("at", T.LongType()).add("gram", T.ArrayType(T.DoubleType()))
    grams = rows.groupBy(*keys).applyInArrow(_gram(len(keys)), schema)
    cells = grams.select(*f.series_keys, "bulk", "at", F.posexplode("gram").alias("cell", "v"))
    group = F.when(F.col("bulk"), F.lit(-1)).otherwise(F.col("at"))
    summed = cells.groupBy(*f.series_keys, group.alias("at"), "cell").agg(F.sum("v").alias("v"))
    counts = grams.filter("bulk").groupBy(*f.series_keys).agg(F.sum("at").alias("rows"))
    packed = (
        summed.groupBy(*f.series_keys, "at")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "v"))), lambda e: e["v"]).alias("gram"))
        .groupBy(*f.series_keys)
        .agg(F.collect_list(F.struct("at", "gram")).alias("parts"))
        .join(counts, list(f.series_keys))
    )

    @F.pandas_udf("struct<used_lag:int,adf_stat:double>")
    def solve(parts: pd.Series, rows: pd.Series) -> pd.DataFrame:
        out = []
        for ps, n in zip(parts, rows):
            side = int(round(math.sqrt(len(ps[0]["gram"]))))
            mats = {int(p["at"]): np.asarray(p["gram"]).reshape(side, side) for p in ps}
            bulk = mats.pop(-1)
            out.append(_pick_lag(bulk, int(n), sorted(mats.items()), side - 3))
        return pd.DataFrame(out, columns=["used_lag", "adf_stat"])

    solved = packed.select(*f.series_keys, solve("parts", "rows").alias("r")).select(*f.series_keys, "r.*")
    return (
        size.select(*f.series_keys, "n_obs")
        .join(solved, list(f.series_keys), "left")
        .withColumn("adf_p", F.coalesce(mackinnon_p("adf_stat"), F.lit(1.0)))
    )


def half_life(df: DataFrame, col: str = "spread", f: Frame = PAIR, cap: float = 100.0) -> DataFrame:
    """Half-life of mean reversion from the regression of changes on levels."""
    df = df.withColumn("_lag", F.lag(col).over(f.ordered())).filter(OWN)
    k = F.regr_slope(F.col(col) - F.col("_lag"), F.col("_lag"))
    life = F.when(F.col("k") < 0, F.least(-F.ln(F.lit(2.0)) / F.col("k"), F.lit(cap))).otherwise(F.lit(cap))
    return df.groupBy(*f.series_keys).agg(k.alias("k")).select(*f.series_keys, life.alias("half_life"))


def hurst(
    df: DataFrame, col: str = "spread", f: Frame = PAIR, max_lags: int = 20, use_std: bool = False, least: int = 100
) -> DataFrame:
    """Scaling exponent of lagged differences.

    ``use_std=False`` halves the slope of log variance; ``use_std=True`` doubles
    the slope of log standard deviation (the optimizer's scale), with 0.5 where
    it cannot be computed.
    """
    keys = list(f.series_keys)
    lags = range(2, max_lags)
    moves = df.selectExpr(
        *[f"`{k}`" for k in keys], OWN, f"`{col}` AS s",
        *[f"`{col}` - lag(`{col}`, {k}) OVER ({f.sql}) AS d{k}" for k in lags],
    ).filter(OWN)
    fn = "stddev_pop" if use_std else "var_pop"
    stats = moves.groupBy(*keys).agg(F.expr("count(s) AS n"), *[F.expr(f"{fn}(d{k}) AS v{k}") for k in lags])
    # a lag takes part only while it is below a quarter of the series length
    points = ", ".join(f"{k}D, v{k}" for k in lags)
    long = stats.selectExpr(*[f"`{k}`" for k in keys], "n", f"stack({len(lags)}, {points}) AS (k, v)").filter(
        "k < floor(n / 4) AND v > 0"
    )
    slope = long.groupBy(*f.series_keys).agg(
        F.regr_slope(F.ln("v"), F.ln("k")).alias("slope"), F.max("n").alias("n")
    )
    scale = 2.0 if use_std else 0.5
    value = F.when(F.col("n") >= least, F.col("slope") * scale)
    if use_std:
        value = F.coalesce(value, F.lit(0.5))
    return stats.select(*f.series_keys).join(slope, list(f.series_keys), "left").select(*f.series_keys, value.alias("hurst"))


def static_spread(df: DataFrame, y: str = "fx_price", x: str = "comd_price", f: Frame = PAIR) -> DataFrame:
    """Attach the full-sample slope and the spread ``y - slope * x`` (full-sample: not usable bar by bar)."""
    slope = df.filter(OWN).groupBy(*f.series_keys).agg(F.regr_slope(y, x).alias("coint_beta"))
    return with_series_stats(df, slope, f).withColumn("coint_spread", F.col(y) - F.col("coint_beta") * F.col(x))


def cointegration(df: DataFrame, threshold: float = 0.05, f: Frame = PAIR) -> DataFrame:
    """Engle-Granger style check of each pair."""
    rows = static_spread(df, f=f)
    test = unit_root_test(rows, "coint_spread", f)
    slope = rows.filter(OWN).groupBy(*f.series_keys).agg(F.max("coint_beta").alias("coint_beta"))
    ok = F.col("coint_beta").isNotNull() & (F.col("n_obs") >= 20)
    return (
        slope.join(test, list(f.series_keys), "left")
        .withColumn("adf_p", F.when(ok, F.col("adf_p")).otherwise(F.lit(1.0)))
        .withColumn("is_cointegrated", F.col("adf_p") < threshold)
    )


def structural_flag(
    df: DataFrame, col: str = "spread", f: Frame = PAIR, adf_p: float | Column = 0.10, cap: float = 252.0, limits: DataFrame | None = None
) -> DataFrame:
    """Per-series flag: stationary, half-life in 2..252 bars, anti-persistent.

    ``adf_p`` may be a column of ``limits``, a table with one row per series.
    """
    key = list(f.series_keys)
    stats = (
        unit_root_test(df, col, f).join(half_life(df, col, f, cap), key).join(hurst(df, col, f), key)
    )
    if limits is not None:
        stats = stats.join(limits, key, "left")
    ok = (F.col("adf_p") <= adf_p) & F.col("half_life").between(2.0, 252.0) & (F.coalesce("hurst", F.lit(0.5)) < 0.6)
    return stats.withColumn("coint_ok", ok)
