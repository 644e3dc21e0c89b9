"""One-pass sweeps and per-pair parameters against plain versions, over many short segments."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from spreadlake.operators import configured, scan_sweep
from spreadlake.operators import signals as S
from spreadlake.series import segment, trim
from spreadlake.sources import config

COMBOS = [(1, 1.0, 0.3, 2.5), (2, 1.5, 0.7, 3.0), (3, 9.0, 0.5, 10.0), (4, 0.4, 0.1, 0.9)]


@pytest.fixture(scope="module")
def short_segments(spark):
    spark.conf.set("spreadlake.segment.rows", "60")
    yield
    spark.conf.unset("spreadlake.segment.rows")


def plain_signal(z, entry, exit_, stop):
    pos, out = 0, []
    for v in z:
        if pos == 0:
            pos = -1 if v >= entry else 1 if v <= -entry else 0
        elif pos * v >= -exit_ or pos * v <= -stop:
            pos = 0
        out.append(pos)
    return np.array(out)


def plain_figures(signal, spread, lo, hi, fill):
    r = np.concatenate([[np.nan], signal[:-1] * np.diff(spread)])
    before = np.concatenate([[np.nan], signal[:-1].astype(float)])
    chg = (signal != before) & ~np.isnan(before)
    counted = chg | (~np.isnan(before) & (signal != 0))
    r, chg, counted, s = r[lo:hi], chg[lo:hi], counted[lo:hi], signal[lo:hi]
    x = r[~np.isnan(r)]
    e = np.cumprod(1 + (np.nan_to_num(r) if fill else x))
    peak = np.maximum.accumulate(e) if len(e) else e
    falls = [(a - b) / b for a, b in zip(e, peak) if b != 0]
    runs = pd.Series(counted).groupby(np.cumsum(chg)).sum()
    return {"n": len(r), "chg": int(chg.sum()), "wins": int((x > 0).sum()), "s": x.sum() if len(x) else None, "dd": min(falls, default=None), "runs": runs[runs > 0].mean() if (runs > 0).any() else 0.0, "std": x.std(ddof=1) if len(x) > 1 else None, "act": (s != 0).mean()}


def z_rows(spark, bars):
    df = S.spread_and_z(segment(bars, S.Rules().lookback, grain_days=10), S.Rules())
    return df, trim(df).orderBy("pair", "ts").toPandas()


def test_sweep_table(spark, bars, short_segments):
    df, plain = z_rows(spark, bars)
    assert df.select("pair", "seg").distinct().count() > 12
    got = scan_sweep.table(df, COMBOS).toPandas().set_index(["pair", "param_id"])
    assert len(got) == 8
    for pair, rows in plain.groupby("pair"):
        for i, *limits in COMBOS:
            want = plain_figures(plain_signal(rows["spread_z"].to_numpy(), *limits), rows["spread"].to_numpy(), 0, len(rows), False)
            g = got.loc[(pair, i)]
            assert g["total_trades"] == want["chg"]
            assert np.allclose(
                [g["win_rate"], g["total_return"], g["max_drawdown"], g["avg_signal_duration"], g["signal_activity"], g["annual_vol"]],
                [want["wins"] / want["chg"] if want["chg"] else 0.0, want["s"], want["dd"], want["runs"], want["act"], want["std"] * np.sqrt(252)],
                atol=1e-9,
            )


def test_fold_table(spark, bars, short_segments):
    df, plain = z_rows(spark, bars)
    years = dict(first_year=2020, train=1, test=1, step=1, count=1)
    got = scan_sweep.fold_table(df, COMBOS, years).toPandas().set_index(["pair", "param_id", "part"])
    assert len(got) == 16
    for pair, rows in plain.groupby("pair"):
        year = rows["ts"].dt.year.to_numpy()
        for i, *limits in COMBOS:
            signal = plain_signal(rows["spread_z"].to_numpy(), *limits)
            for part, at in (("train", np.flatnonzero(year == 2020)[:-40]), ("test", np.flatnonzero(year == 2021)[20:])):
                want = plain_figures(signal, rows["spread"].to_numpy(), at[0], at[-1] + 1, True)
                g = got.loc[(pair, i, part)]
                assert g["num_trades"] == want["chg"] and np.allclose([g["total_return"], g["max_drawdown"]], [want["s"], want["dd"]], atol=1e-9)


def test_sweep_of_no_bars(spark, bars):
    df = S.spread_and_z(segment(bars.limit(0), S.Rules().lookback), S.Rules())
    assert scan_sweep.table(df, COMBOS).count() == 0


SECTIONS = {
    "p": {"lookbacks": {"beta_window": 30, "z_window": 15}, "thresholds": {"entry_z": 1.1, "exit_z": 0.2}, "regime": {"min_abs_corr": 0.05}, "time_stop": {"max_days": 3}},
    "q": {"lookbacks": {"beta_window": 90, "corr_window": 30}, "thresholds": {"entry_z": 0.9}, "inverse_fx_for_quote_ccy_strength": False, "exec": {"costs": {"fx_bps": 7}}},
    "unseen": {"thresholds": {"entry_z": 1.5}},
}


def test_pairs_with_their_own_parameters(spark, bars):
    """Every pair's signals are those of a plan of its own with plain numbers."""
    params = config.params_frame(spark, SECTIONS)
    got = trim(configured.generate(bars, params))
    cols = ["ts", "signal", "spread_z", "entry_z_dyn", "exit_z_dyn", "fx_position", "comd_position"]
    row = {r.pair: r for r in params.collect()}
    for pair in ("p", "q"):
        r = row[pair]
        rules = S.Rules(
            beta_window=r.beta_window, z_window=r.z_window, corr_window=r.corr_window, entry_z=r.entry_z, exit_z=r.exit_z, stop_z=r.stop_z, adf_p=r.adf_p,
            min_abs_corr=r.min_abs_corr, max_days=r.max_days, inverse_fx=r.inverse_fx, use_rls=r.use_rls, atr_window=r.atr_window, target_vol_per_leg=r.target_vol_per_leg,
        )
        want = S.signals_table(bars.filter(F.col("pair") == pair), rules).select(*cols).orderBy("ts").toPandas()
        mine = got.filter(F.col("pair") == pair).select(*cols).orderBy("ts").toPandas()
        pd.testing.assert_frame_equal(mine, want)
        assert (want["signal"] != 0).sum() > 20
    assert {r.pair for r in got.select("pair").distinct().collect()} == {"p", "q"}


def test_bad_thresholds_name_the_pair(spark, bars):
    params = config.params_frame(spark, SECTIONS | {"bad": {"thresholds": {"entry_z": 4.0, "stop_z": 3.0}}})
    with pytest.raises(ValueError, match="bad"):
        configured.generate(bars, params)


def test_sections_from_a_file(spark, tmp_path):
    import json

    (tmp_path / "pairs.json").write_text(json.dumps(SECTIONS))
    assert config.read_sections(spark, str(tmp_path / "pairs.json")) == SECTIONS


def test_bootstrap_is_a_resampling(spark):
    """The interval is that of a plain bootstrap to sampling error, the same however rows are dealt out; nulls are left out."""
    from spreadlake.operators import sweep

    rng = np.random.default_rng(6)
    rows = [("a" if i % 3 else "b", i, float(rng.normal(0.1, 1.0)) if i % 50 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "pair string, trade_id long, r double")
    got = {r.pair: r for r in sweep.bootstrap(df, "r", ["trade_id"], replicates=400).collect()}
    again = {r.pair: r for r in sweep.bootstrap(df.repartition(7, "trade_id"), "r", ["trade_id"], replicates=400).collect()}
    for pair in ("a", "b"):
        x = np.array([v for p, _, v in rows if p == pair and v is not None])
        means = [rng.choice(x, len(x)).mean() for _ in range(2000)]
        error = x.std() / np.sqrt(len(x))
        assert abs(got[pair].lo - np.quantile(means, 0.025)) < 0.5 * error and abs(got[pair].hi - np.quantile(means, 0.975)) < 0.5 * error
        assert np.allclose([got[pair].lo, got[pair].hi], [again[pair].lo, again[pair].hi])
    weights = sweep.replicate_weights(np.arange(5000, dtype=np.int64), 100)
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02
    assert sweep.bootstrap(df.limit(0), "r", ["trade_id"]).count() == 0
