"""Ablations A0 to A5 over walk-forward folds, and runs that fail their checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlake.operators import backtest as B
from spreadlake.operators import signals as S
from spreadlake.operators import sweep as X
from spreadlake.series import trim

YEARS = dict(first_year=2020, train=1, test=1, step=1, count=1)
BASE = S.Rules(entry_z=1.0, hmm=(126, 3.0))


def test_ablations_switch_off_one_part_each():
    runs = X.ablations(BASE)
    assert [n[:2] for n in runs] == ["A0", "A1", "A2", "A3", "A4", "A5"] and runs["A0_baseline"] == BASE
    assert len(set(runs.values())) == 6


def test_switches_reach_the_plan(spark, bars, pairs):
    plain = S.Rules(structural_scale=False, vol_scale=False, corr_gate=False, robust_z=False)
    got = trim(S.generate(bars, plain)).toPandas().sort_values(["pair", "ts"])
    assert (got["entry_z_dyn"] == 1.5).all() and (got["exit_z_dyn"] == 0.5).all() and got["regime_ok"].all()
    for _, one in got.groupby("pair"):
        roll = one["spread"].rolling(20)
        assert np.allclose(one["spread_z"], (one["spread"] - roll.mean()) / roll.std(), equal_nan=True)


def test_marked_parts_keep_what_purging_keeps(spark, bars):
    folds = X.assign_folds(bars, **YEARS)
    want = X.purge_folds(folds, ("pair",)).select("pair", "fold", "ts", F.col("part").alias("use"))
    got = X.marked_parts(folds)
    assert got.count() == folds.count()
    assert sorted(got.filter("use IS NOT NULL").select(*want.columns).collect()) == sorted(want.collect())


def test_six_rows_per_pair_scored_on_test_bars_and_a_row_for_a_failed_run(spark, bars):
    # the state is given, so that no fit is needed: open but for every third bar
    given = bars.withColumn("hmm_state", (F.dayofyear("ts") % 3 == 0).cast("int"))
    runs = X.ablations(S.Rules(entry_z=1.0)) | {"bad": S.Rules(entry_z=4.0)}
    got = {(r["pair"], r["variant"]): r for r in X.compare(given, runs, YEARS).collect()}
    assert set(got) == {(p, n) for p in ("p", "q") for n in runs}
    for p in ("p", "q"):
        bad = got[p, "bad"]
        assert bad["error"] == "stop_z must be above entry_z" and bad["sharpe_ratio"] is None
        assert all(got[p, n]["error"] is None and got[p, n]["folds"] == 1 for n in runs if n != "bad")
    marked = X.marked_parts(X.assign_folds(given, **YEARS))
    f = X.FOLD_FRAME
    for name in ("A0_baseline", "A5_plain_z"):
        bt = B.run(S.generate(marked, runs[name], f=f, fit=F.col("use") == "train"), f=f).toPandas().sort_values("ts")
        for p, one in bt[bt["use"] == "test"].groupby("pair"):
            equity = (1 + one["pnl"]).cumprod()
            peak = np.maximum(equity.cummax(), 1.0)
            assert got[p, name]["total_return"] == pytest.approx(equity.iloc[-1] - 1, abs=1e-12)
            assert got[p, name]["max_drawdown"] == pytest.approx(((equity - peak) / peak).min(), abs=1e-12)


def test_states_are_fitted_once_and_equal_those_of_the_plan(spark, bars):
    one = bars.filter("pair = 'p'").limit(300)
    given = X.with_states(one, BASE)
    want = trim(S.flagged_bars(one, BASE)).select("ts", "regime_ok").collect()
    assert sorted(trim(S.flagged_bars(given, BASE)).select("ts", "regime_ok").collect()) == sorted(want)
