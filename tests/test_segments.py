"""Cutting a series into segments must not change any result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spreadlake.functions import rolling as R
from spreadlake.operators import backtest as B
from spreadlake.operators import hedge as H
from spreadlake.operators import signals as S
from spreadlake.operators import structure as C
from spreadlake.operators.asof import asof_join
from spreadlake.series import OWN, PAIR, compound, forward_fill, running_sum, segment, trim

CUTS = dict(rows=90, grain_days=7.0)


def table(df, *cols):
    return df.select("pair", "ts", *cols).toPandas().sort_values(["pair", "ts"]).reset_index(drop=True)


def test_every_bar_owned_once_and_halo_complete(bars):
    seg = segment(bars, 50, **CUTS)
    assert seg.select("seg").distinct().count() > 5
    own = seg.filter(OWN)
    assert own.count() == bars.count() == own.dropDuplicates(["pair", "ts"]).count()
    halo = seg.groupBy("pair", "seg").agg(F.count_if(~F.col(OWN)).alias("h"), F.min("seg_off").alias("o")).toPandas()
    assert ((halo["h"] >= 50) | (halo["o"] == 0)).all()


def test_rolling_expressions_match_pandas(bars, pairs):
    got = table(trim(segment(bars, 61, **CUTS).withColumns({"z": R.zscore(F.col("fx_price"), 20), "b": R.beta(F.col("fx_price"), F.col("comd_price"), 60), "c": R.corr(F.col("fx_price"), F.col("comd_price"), 20)})), "z", "b", "c")
    for pair, g in pairs.groupby("pair"):
        r = got[got["pair"] == pair].reset_index(drop=True)
        y, x = g["fx_price"].reset_index(drop=True), g["comd_price"].reset_index(drop=True)
        np.testing.assert_allclose(r["z"].astype(float), (y - y.rolling(20).mean()) / y.rolling(20).std(), rtol=1e-9, equal_nan=True)
        np.testing.assert_allclose(r["b"].astype(float), y.rolling(60).cov(x) / x.rolling(60).var(), rtol=1e-6, equal_nan=True)
        np.testing.assert_allclose(r["c"].astype(float), y.rolling(20).corr(x), rtol=1e-6, atol=1e-9, equal_nan=True)


def test_recursive_estimate_matches_recursion_across_segments(spark, bars, pairs):
    lam, delta = 0.9, 10.0
    look = H.rls_lookback(lam)
    got = table(trim(H.rls(segment(bars, look, rows=400, grain_days=7.0), F.ln("fx_price"), F.ln("comd_price"), lam, delta)), "alpha", "beta")
    for pair, g in pairs.groupby("pair"):
        theta, p = np.zeros(2), np.eye(2) * delta
        want = []
        for y, x in zip(np.log(g["fx_price"]), np.log(g["comd_price"])):
            v = np.array([1.0, x])
            k = p @ v / (lam + v @ p @ v)
            theta = theta + k * (y - v @ theta)
            p = (p - np.outer(k, v) @ p) / lam
            want.append(theta.copy())
        r = got[got["pair"] == pair][["alpha", "beta"]].to_numpy(dtype=float)
        np.testing.assert_allclose(r[5:], np.array(want)[5:], rtol=1e-4, atol=1e-6)


def test_running_quantities_cross_segments(bars, pairs):
    df = segment(bars, 3, **CUTS).withColumn("g", 1 + (F.col("fx_price") - 5.5) / 4)
    df = running_sum(compound(df, F.col("g")), {"total": F.col("fx_price")})
    got = table(trim(df), "equity", "peak", "total")
    for pair, g in pairs.groupby("pair"):
        r = got[got["pair"] == pair]
        eq = (1 + (g["fx_price"] - 5.5) / 4).cumprod().to_numpy()
        np.testing.assert_allclose(r["equity"], eq, rtol=1e-9)
        np.testing.assert_allclose(r["peak"], np.maximum.accumulate(eq), rtol=1e-9)
        np.testing.assert_allclose(r["total"], g["fx_price"].cumsum(), rtol=1e-12)


def test_forward_fill_over_a_gap_longer_than_a_segment(bars, pairs):
    sparse = bars.withColumn("v", F.when(F.dayofyear("ts") == 40, F.col("fx_price")))
    got = table(trim(forward_fill(segment(sparse, 1, **CUTS), ["v"])), "v")
    for pair, g in pairs.groupby("pair"):
        want = g["fx_price"].where(g["ts"].dt.dayofyear == 40).ffill()
        np.testing.assert_allclose(got[got["pair"] == pair]["v"].astype(float), want, equal_nan=True)


def walk(raw, lo, so, gate, max_bars=None):
    pos, held, out = 0, 0, []
    for r, a, b, g in zip(raw, lo, so, gate):
        if pos == 0:
            pos, held = r, int(r != 0)
        else:
            held += 1
            if (a if pos == 1 else b) or (max_bars is not None and held >= max_bars):
                pos, held = 0, 0
        out.append(pos if g else 0)
    return out


@pytest.mark.parametrize("max_bars", [None, 2, 7])
def test_position_states_match_plain_loop(spark, max_bars):
    rng = np.random.default_rng(11)
    n = 900
    frames = [
        pd.DataFrame({"pair": p, "ts": pd.date_range("2020-01-01", periods=n), "raw": rng.choice([-1, 0, 0, 1], n), "lo": rng.random(n) < 0.1, "so": rng.random(n) < 0.1, "gate": rng.random(n) < 0.8})
        for p in ("a", "b")
    ]
    src = pd.concat(frames, ignore_index=True)
    df = segment(spark.createDataFrame(src.sample(frac=1, random_state=3)), 12, **CUTS)
    from spreadlake.operators.states import position_states

    out = position_states(df, F.col("raw") == 1, F.col("raw") == -1, F.col("lo"), F.col("so"), F.col("gate"), max_bars, tail=6)
    out = out.withColumn("before", F.lag("signal").over(PAIR.ordered()))
    got = table(trim(out), "signal", "before", "since")
    for p, g in src.groupby("pair"):
        r = got[got["pair"] == p].reset_index(drop=True)
        want = pd.Series(walk(g["raw"], g["lo"], g["so"], g["gate"], max_bars))
        assert r["signal"].tolist() == want.tolist()
        # the halo rows before each segment carry the right signal as well
        assert r["before"].fillna(0).astype(int).tolist() == want.shift(1).fillna(0).astype(int).tolist()
        start = g["ts"].reset_index(drop=True).where((want != 0) & (want.shift(1).fillna(0) == 0)).ffill().where(want != 0)
        assert r["since"].astype("datetime64[ns]").equals(start.astype("datetime64[ns]"))


def test_position_held_through_many_segments(spark):
    n = 600
    src = pd.DataFrame({"pair": "a", "ts": pd.date_range("2020-01-01", periods=n), "go": [i == 3 for i in range(n)], "out": [i == 580 for i in range(n)]})
    from spreadlake.operators.states import position_states

    df = segment(spark.createDataFrame(src), 12, **CUTS)
    got = table(trim(position_states(df, F.col("go"), F.lit(False), F.col("out"), F.col("out"))), "signal", "since")
    assert got["signal"].tolist() == [1 if 3 <= i < 580 else 0 for i in range(n)]
    assert got["since"].dropna().nunique() == 1


def test_whole_plan_is_the_same_in_one_or_many_segments(spark, bars):
    rules = S.Rules(use_rls=False, entry_z=1.0, min_abs_corr=0.0)

    def run(rows):
        spark.conf.set("spreadlake.segment.rows", str(rows))
        try:
            return table(B.run(S.generate(bars, rules)), "signal", "equity", "drawdown", "trade_id", "pnl")
        finally:
            spark.conf.unset("spreadlake.segment.rows")

    one, many = run(100_000), run(150)
    assert one["signal"].abs().sum() > 20
    pd.testing.assert_frame_equal(one, many, rtol=1e-9)


def test_asof_join_matches_merge_asof(spark):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"pair": "k", "ts": pd.to_datetime("2020-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 10**7, 400)), unit="s"), "a": range(400)}).drop_duplicates("ts")
    right = pd.DataFrame({"pair": "k", "ts": pd.to_datetime("2020-01-05") + pd.to_timedelta(np.sort(rng.integers(0, 10**7, 30)), unit="s"), "b": range(30)}).drop_duplicates("ts")
    spark.conf.set("spreadlake.segment.rows", "50")
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), grain_days=1).toPandas().sort_values("ts")
    spark.conf.unset("spreadlake.segment.rows")
    want = pd.merge_asof(left, right.drop(columns="pair"), on="ts")
    np.testing.assert_allclose(got["b"].astype(float), want["b"].astype(float), equal_nan=True)


def test_no_bar_exchange_on_the_series_key_alone(bars):
    """All windows of the spread plan run on (pair, seg); bars are never hashed by pair only."""
    df = S.spread_and_z(segment(bars, 400), S.Rules())
    plan = df._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("windowspecdefinition(pair" in line and ", seg#" in line for line in windows)
    sorts = [line for line in plan.splitlines() if "Exchange hashpartitioning(pair" in line and ", seg#" in line]
    assert sorts


def test_unit_root_lag_search_matches_plain_regression(bars, pairs):
    seg = segment(bars, 40, rows=200, grain_days=7.0)
    got = C.unit_root_test_auto(seg, "fx_price").toPandas().set_index("pair")
    for pair, g in pairs.groupby("pair"):
        s = g["fx_price"].to_numpy()
        cap = C.default_max_lag(len(s))
        d = np.diff(s)

        def fit(lag, first):
            t = np.arange(first, len(d))
            x = np.column_stack([np.ones(len(t)), s[t]] + [d[t - j] for j in range(1, lag + 1)])
            b, *_ = np.linalg.lstsq(x, d[t], rcond=None)
            rss = ((d[t] - x @ b) ** 2).sum()
            se = np.sqrt(rss / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
            return len(t) * np.log(rss / len(t)) + 2 * x.shape[1], b[1] / se

        best = min(range(cap + 1), key=lambda k: fit(k, cap)[0])
        assert got.loc[pair, "used_lag"] == best
        assert got.loc[pair, "adf_stat"] == pytest.approx(fit(best, best)[1], rel=1e-6)
