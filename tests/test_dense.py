"""Dense series, real configuration shapes, exact quantiles and batch-independent fits."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F
from spreadlake.functions import rolling as R
from spreadlake.operators import hedge, hidden_states, metrics, quality, risk, sweep
from spreadlake.series import segment, trim
from spreadlake.sources import config


@pytest.fixture(scope="module")
def minutes(spark):
    n = 12_000
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, n)
    pdf = pd.DataFrame({"pair": "p", "ts": pd.date_range("2020-01-01", periods=n, freq="min"), "y": 2 + 0.5 * x + rng.normal(0, 0.1, n), "x": x})
    return pdf, spark.createDataFrame(pdf)


def test_recursion_on_minute_bars(minutes):
    """Weights are re-based, so long segments and many of them equal the plain recursion."""
    pdf, df = minutes
    lam, p, theta, want = 0.97, np.eye(2) * 1000, np.zeros(2), []
    for y, x in zip(pdf["y"], pdf["x"]):
        v = np.array([1, x])
        k = p @ v / (lam + v @ p @ v)
        theta = theta + k * (y - v @ theta)
        p = (p - np.outer(k, v) @ p) / lam
        want.append(theta[1])
    for rows in (2000, 100_000):
        cut = segment(df, hedge.rls_lookback(lam), rows=rows)
        got = trim(hedge.rls(cut, F.col("y"), F.col("x"), lam)).orderBy("ts").toPandas()["beta"]
        assert len(got) == len(want) and not got.isna().any() and np.abs(got - want).max() < 1e-9


def test_segments_are_bounded_by_rows(spark):
    """All ticks of one day, and half of them in one second, still make segments of about ``rows``."""
    at = F.when(F.col("id") < 20_000, F.col("id") * 50).otherwise(F.col("id") * 2_000_000)
    ticks = spark.range(40_000).select(F.lit("p").alias("pair"), F.timestamp_micros(F.lit(1_600_000_000_000_000) + at).alias("ts"), "id")
    cut = segment(ticks, 50, rows=4000, grain_days=1.0)
    sizes = cut.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("own")).toPandas()
    assert sizes["n"].max() < 2 * 4000 + 50 and sizes["own"].sum() == 40_000 and len(sizes) >= 9


def test_configuration_of_the_real_shape(spark):
    sections = {
        "a": {"fx_symbol": "A", "comd_symbol": "B", "inverse_fx_for_quote_ccy_strength": False, "regime": {"volatility_window": 33, "enable_hmm": True, "min_abs_corr": 0.4, "hmm": {"df": 5.0, "tol": "1e-3"}, "vix": {"thresh": 25}}, "min_trade_count": 7, "rolling_metrics": {"windows": {"30D": 30}}},
        "b": {"fx_symbol": "A", "comd_symbol": "C", "lookbacks": {"beta_window": 5, "z_window": 40}, "thresholds": {"entry_z": 2.0, "exit_z": 1.0, "stop_z": 3.5}, "sizing": {"target_vol_per_leg": 0.01, "atr_window": 20}, "regime": {"min_abs_corr": 0.4}},
    }
    got = {r["pair"]: r for r in config.params_frame(spark, sections).collect()}
    assert (got["a"]["inverse_fx"], got["a"]["vol_window"], got["a"]["enable_hmm"], got["a"]["hmm_df"], got["a"]["hmm_tol"], got["a"]["min_trade_count"], got["a"]["windows"]) == (False, 33, True, 5.0, 1e-3, 7, {"30D": 30})
    assert (got["b"]["inverse_fx"], got["b"]["enable_hmm"], got["b"]["vix_thresh"]) == (True, False, 20.0)
    bad = {(r["pair"], r["path"], r["problem"]) for r in quality.config_violations(spark, sections).collect()}
    assert bad == {("a", "lookbacks", "section missing"), ("a", "thresholds", "section missing"), ("a", "sizing", "section missing"), ("b", "lookbacks.beta_window", "not in [10, 500]"), ("b", "lookbacks.corr_window", "key missing")}


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"pair": ["p"] * 5000 + ["q"] * 3 + ["r"], "v": np.concatenate([rng.normal(0, 1, 4000), np.zeros(1000), [1.0, 2.0, 4.0], [np.nan]])})
    got = metrics.quantiles(spark.createDataFrame(pdf), "v", {"low": 0.01, "mid": 0.5, "high": 0.995}).toPandas().set_index("pair")
    for pair in ("p", "q"):
        want = np.quantile(pdf.loc[pdf["pair"] == pair, "v"], [0.01, 0.5, 0.995])
        assert np.allclose(got.loc[pair, ["low", "mid", "high"]].astype(float), want)
    assert "r" not in got.index


def test_hidden_states_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, s, (6, 60)) for s in (0.5, 1.0, 3.0)])
    together = hidden_states._last_states(x, 3, 3.0, 60, 1e-4)
    alone = [hidden_states._last_states(x[i : i + 1], 3, 3.0, 60, 1e-4)[0] for i in range(len(x))]
    assert list(together) == alone


def test_grids_reports_and_scenarios(spark):
    assert sweep.threshold_grid(spark).count() == 276 / 3 and sweep.run_grid(spark).count() == 45
    assert sweep.folds(spark, 2015, 5, 1, 1, 6).count() == 6
    assert risk.scenario_table(spark).count() == 7
    results = spark.createDataFrame([("p", "Flash Crash", -0.25, 0.9, 3)], "pair string, name string, max_drawdown double, final_equity double, violations long")
    assert risk.stress_report(results).first()["line"] == "Flash Crash | max drawdown -25.00% | final equity 0.90 | violations 3"


def test_sliding_slopes_equal_those_of_frames(spark):
    """Running sums, cut into segments, give the frames' slopes to 1e-9, with gaps and a stretch that does not move."""
    rng = np.random.default_rng(9)
    n = 6000
    x = 100 + np.cumsum(rng.normal(0, 0.1, n))
    x[2000:2400] = x[2000]
    y = 0.5 * x + rng.normal(0, 0.2, n)
    rows = [("p", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), None if i % 97 == 0 else float(y[i]), float(x[i])) for i in range(n)]
    bars = spark.createDataFrame(rows, "pair string, ts timestamp, y double, x double")
    seg = segment(bars, 300, rows=700, grain_days=0.02)
    assert seg.select("seg").distinct().count() > 5
    for skip in (0, 1):
        got = trim(R.with_sliding_slope(seg, F.col("y"), F.col("x"), 252, "b", "n", skip=skip)).toPandas().sort_values("ts").reset_index(drop=True)
        frame = (-(252 + skip - 1), -skip)
        w = Window.partitionBy("pair").orderBy("ts").rowsBetween(*frame)
        want = bars.withColumns({"b": F.regr_slope("y", "x").over(w), "n": F.count("y").over(w)}).toPandas().sort_values("ts").reset_index(drop=True)
        assert (got["n"] == want["n"]).all()
        moves = np.array([i > 10 and not (2000 <= i - skip - 251 and i - skip < 2400) for i in range(n)])
        assert np.nanmax(np.abs(got["b"] - want["b"])[moves & (want["n"] > 10)]) < 1e-7
        still = np.array([2000 <= i - skip - 251 and i - skip < 2400 for i in range(n)])
        assert got["b"][still].isna().all()
