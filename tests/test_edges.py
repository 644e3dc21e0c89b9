"""Edge fixtures: constants, gaps, short series, bad prices, no trades, total losses."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spreadlake.functions import costs as K
from spreadlake.functions import rolling as R
from spreadlake.operators import backtest as B
from spreadlake.operators import hedge as H
from spreadlake.operators import hidden_states, metrics, quality, risk
from spreadlake.operators import regime as G
from spreadlake.operators import signals as S
from spreadlake.operators import structure as C
from spreadlake.operators import sweep as X
from spreadlake.series import segment, trim
from spreadlake.sources import bars as SB
from spreadlake.sources import calendar as Cal
from spreadlake.sources import config as Cfg


def frame(spark, fx, comd, pair="a"):
    ts = pd.date_range("2021-01-01", periods=len(fx))
    rows = [(pair, t.to_pydatetime(), None if f is None else float(f), None if c is None else float(c)) for t, f, c in zip(ts, fx, comd)]
    return spark.createDataFrame(rows, "pair string, ts timestamp, fx_price double, comd_price double")


def test_constant_series_give_null_not_errors(spark):
    seg = segment(frame(spark, [2.0] * 120, [3.0] * 120), 60)
    fx, cm = F.col("fx_price"), F.col("comd_price")
    df = trim(R.with_robust_z(seg, "fx_price", 20, "rz").withColumns({"z": R.zscore(fx), "c": R.corr(fx, cm, 20), "b": R.beta(fx, cm, 20)}))
    assert df.filter("rz IS NOT NULL OR z IS NOT NULL OR c IS NOT NULL OR b IS NOT NULL").count() == 0
    assert trim(seg.withColumn("ok", G.correlation_gate(fx, cm, 20))).filter("ok").count() == 0


def test_short_and_single_row_series(spark):
    for n in (1, 9):
        seg = segment(frame(spark, [2.0 + i for i in range(n)], [3.0 + i for i in range(n)]), 60)
        assert trim(H.with_spread(seg, 60)).filter("spread IS NOT NULL").count() == 0
        row = C.unit_root_test(seg, "fx_price").first()
        assert row["adf_p"] == 1.0
        assert C.hurst(seg, "fx_price").first()["hurst"] is None


def test_bad_prices_take_the_previous_estimate(spark):
    rng = np.random.default_rng(0)
    x = 50 + rng.normal(0, 1, 150).cumsum() * 0.2
    y = 0.1 * x + rng.normal(0, 0.05, 150)
    y[70], x[90], y[100] = -1.0, float("inf"), float("nan")
    out = trim(H.with_spread(segment(frame(spark, y, x), 200), 20)).orderBy("ts").toPandas()
    for bad in (70, 90, 100):
        assert out["alpha"][bad] == out["alpha"][bad - 1] and out["spread"][bad] == out["spread"][bad - 1]
    clean = [i for i in range(150) if i not in (70, 90, 100)]
    alone = trim(H.with_spread(segment(frame(spark, y[clean], x[clean]), 200), 20)).orderBy("ts").toPandas()
    np.testing.assert_allclose(out["beta"].to_numpy()[clean], alone["beta"], rtol=1e-12)


def signal_frame(spark, signals, fx, position=1.0):
    df = frame(spark, fx, [10.0] * len(fx)).toPandas()
    df["signal"], df["fx_position"], df["comd_position"], df["spread_z"] = signals, [s * position for s in signals], 0.0, 0.0
    return spark.createDataFrame(df).withColumn("signal", F.col("signal").cast("int"))


def test_no_trades(spark):
    bt = B.from_table(signal_frame(spark, [0] * 30, np.linspace(1, 2, 30)))
    m = B.metrics(bt).first()
    assert (m["num_trades"], m["win_rate"], m["profit_factor"], m["sharpe_ratio"], m["total_return"]) == (0, 0.0, 0.0, 0.0, 0.0)
    assert B.trades(bt).count() == 0 and B.trades(bt, compat=True).count() == 1


def test_only_wins_and_open_position_at_the_end(spark):
    bt = B.from_table(signal_frame(spark, [0, 1, 1, 0, 0, 1, 1, 1], np.arange(1.0, 9.0), 0.01))
    m = B.metrics(bt).first()
    assert m["profit_factor"] == 999.0 and m["win_rate"] == 1.0
    assert B.trades(bt).count() == 2


def test_loss_above_the_stake(spark):
    bt = B.from_table(signal_frame(spark, [1] * 3 + [0] * 7, [5, 4, 3, 2, 2, 2, 2, 2, 2, 2], 1.5))
    rows = bt.orderBy("ts").toPandas()
    np.testing.assert_allclose(rows["equity"], (1 + rows["pnl"]).cumprod())
    assert rows["equity"].min() < 0 and B.metrics(bt).first()["annual_return"] is None


def test_thresholds_are_checked(spark):
    df = signal_frame(spark, [0], [1.0])
    with pytest.raises(ValueError):
        B.check_inputs(df, 1.0, 2.0, 3.0)
    with pytest.raises(ValueError):
        B.check_inputs(df.drop("spread_z"), 2.0, 1.0, 3.0)


def test_time_stop_hits_one_bar_or_ends_the_run(spark):
    df = segment(frame(spark, [1.0] * 12, [1.0] * 12), 12)
    enter, leave = F.col("ts") == F.lit("2021-01-03").cast("timestamp"), F.lit(False)
    from spreadlake.operators.states import position_states

    pos = position_states(df, enter, leave, leave, leave)
    one = [r["signal"] for r in trim(S.time_stop(pos, F.lit(4))).orderBy("ts").collect()]
    end = [r["signal"] for r in trim(S.time_stop(pos, F.lit(4), close_run=True)).orderBy("ts").collect()]
    assert one == [0, 0, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1] and end == [0, 0, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0]


def test_no_look_ahead(spark, bars):
    rules = S.Rules(use_rls=False)
    cut = F.col("ts") < F.lit("2021-06-01").cast("timestamp")
    cols = ["spread", "spread_z", "alpha", "beta"]
    whole = trim(S.spread_and_z(segment(bars, rules.lookback), rules)).filter(cut).orderBy("pair", "ts").select(*cols).toPandas()
    part = trim(S.spread_and_z(segment(bars.filter(cut), rules.lookback), rules)).orderBy("pair", "ts").select(*cols).toPandas()
    pd.testing.assert_frame_equal(whole, part, rtol=1e-12)


def test_pairs_do_not_influence_each_other(spark, bars):
    rules = S.Rules(use_rls=False, entry_z=1.0)
    both = trim(S.generate(bars, rules)).filter("pair = 'p'").orderBy("ts").select("signal", "spread_z").toPandas()
    alone = trim(S.generate(bars.filter("pair = 'p'"), rules)).orderBy("ts").select("signal", "spread_z").toPandas()
    pd.testing.assert_frame_equal(both, alone, rtol=1e-12)


def test_costs_follow_their_parts(spark):
    df = spark.createDataFrame([(1.3, 1000.0, 0.002)], "p double, q double, atr double")
    p, q = F.col("p"), F.col("q")
    r = df.select(
        K.market_impact(q, p, K.FX).alias("impact"), K.slippage(p, q, K.FX, "market").alias("market"), K.slippage(p, q, K.FX, "limit").alias("limit"),
        K.execution_price(p, -q, F.lit(0.01)).alias("sell"), K.execution_price(p, F.lit(0.0), F.lit(0.01)).alias("none"),
    ).first()
    assert r["impact"] == pytest.approx(1.3 * 0.05)  # capped
    assert r["market"] - r["limit"] == pytest.approx(1.5e-4 * 1.3)
    assert r["sell"] == pytest.approx(1.29) and r["none"] == 1.3


def test_configuration(spark):
    params = Cfg.params_frame(spark, {"x": {"thresholds": {"exit_z": "1e-3"}, "lookbacks": {"z_window": "30"}}})
    row = params.first()
    assert row["exit_z"] == 0.001 and row["z_window"] == 30 and row["entry_z"] == 1.0
    with pytest.raises(KeyError):
        Cfg.risk_params({}, "x")
    report = quality.params_report(params, quality.rule_table(spark)).filter("NOT valid").count()
    assert report == 0


def test_argument_checks():
    for bad in (("", "2020-01-01", "2021-01-01"), ("x", "2020-1-x", "2021-01-01"), ("x", "2021-01-01", "2020-01-01")):
        with pytest.raises(ValueError):
            SB.check_range(*bad)
    with pytest.raises(ValueError):
        G.correlation_gate(None, None, 4)


def test_blackout_days_cover_the_impact_window(spark):
    ev = spark.sql("SELECT date'2021-01-05' AS event_date, 3 AS impact_days UNION ALL SELECT date'2021-01-06', 2")
    tagged = Cal.tag_blackouts(frame(spark, [1.0] * 10, [1.0] * 10), ev).filter("is_blackout").count()
    assert tagged == 3


def test_hidden_states_follow_the_scale_of_returns(spark):
    rng = np.random.default_rng(1)
    r = np.concatenate([rng.normal(0, 0.002, 200), rng.normal(0, 0.05, 120)])
    df = segment(frame(spark, r, [1.0] * len(r)), 61)
    out = trim(hidden_states.hidden_regime(df, "fx_price", window=60)).orderBy("ts").toPandas()["hmm_state"]
    assert (out[:60] == 0).all() and set(out) <= {0, 1, 2}


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"pair": "a", "k": range(300), "v": rng.normal(0.5, 1, 300)}))
    a = X.bootstrap(df, "v", ["k"], 100).first()
    b = X.bootstrap(df.repartition(5), "v", ["k"], 100).first()
    assert abs(a["lo"] - b["lo"]) < 1e-9 and a["lo"] < df.agg(F.avg("v")).first()[0] < a["hi"]


def test_rolling_drawdown_and_ratios(spark):
    eq = [1.0, 1.1, 0.99, 1.2, 0.6, 0.9]
    df = spark.createDataFrame([("a", datetime(2021, 1, 1 + i), e) for i, e in enumerate(eq)], "pair string, ts timestamp, equity double")
    out = trim(metrics.equity_frame(df, 4).withColumns({"dd": metrics.rolling_drawdown(4), "s": metrics.rolling_sortino(4)})).orderBy("ts").toPandas()
    np.testing.assert_allclose(out["dd"].to_numpy(float), [np.nan] * 3 + [-0.1, -0.5, -0.5], equal_nan=True)


def test_position_size_caps(spark):
    df = spark.createDataFrame([(1, 1.3, 60.0, 0.5, 0.5, 0.01, 0.6, 0.05)], "signal int, fx_price double, comd_price double, fx_vol double, comd_vol double, fx_atr double, comd_atr double, stop_distance double")
    r = risk.position_size(df, 10.0).first()
    value = abs(r["fx_order"] * 1.3) + abs(r["comd_order"] * 60)
    assert value <= 1.0 + 1e-9 and value * 0.05 <= 0.1 + 1e-9 and r["fx_order"] > 0 > r["comd_order"]
