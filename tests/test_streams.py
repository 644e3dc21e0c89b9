"""Streams whose rows come out of order give the batch's rows; rows below the watermark are counted."""

import datetime as dt

import numpy as np
import pytest

from pyspark.sql import functions as F
from spreadlake.operators import risk as K
from spreadlake.operators import signals as S
from spreadlake.plans.learning_cases import STATE_CONF
from spreadlake.series import segment, trim
from spreadlake.streaming import live


def feed(spark, tmp_path, build, slices):
    """Run the stream once per slice; its rows and the number of late ones."""
    old = spark.conf.get(STATE_CONF[0], None)
    spark.conf.set(*STATE_CONF)
    base, late = str(tmp_path), 0
    try:
        for part in slices:
            part.write.mode("append").parquet(f"{base}/in")
            out = build(spark.readStream.schema(part.schema).parquet(f"{base}/in")).writeStream.format("parquet").option("checkpointLocation", f"{base}/state")
            query = out.option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            late += live.late_rows(query)
    finally:
        spark.conf.unset(STATE_CONF[0]) if old is None else spark.conf.set(STATE_CONF[0], old)
    return spark.read.parquet(f"{base}/out"), late


def test_disordered_bars(spark, bars, tmp_path):
    """Shuffled bars within the watermark equal the batch; bars below it are left out and counted."""
    rows = bars.withColumn("slot", F.floor((F.unix_micros("ts") / 86_400_000_000 + F.pmod(F.xxhash64("pair", "ts"), F.lit(15))) / 250))
    slots = sorted(r.slot for r in rows.select("slot").distinct().collect())
    slices = [rows.filter(F.col("slot") == s).drop("slot").orderBy(F.rand(1)) for s in slots]
    slices[-1] = slices[-1].unionByName(bars.orderBy("ts").limit(3))  # long gone: the watermark has passed them
    got, late = feed(spark, tmp_path, lambda t: live.live_signals(t, late="20 days"), slices)
    assert late == 3
    end = bars.agg(F.max("ts")).first()[0] - dt.timedelta(days=20)
    df = S.spread_and_z(segment(bars, S.Rules().lookback), S.Rules())
    want = trim(S.positions(S.rule_flags(df, F.lit(1.5), F.lit(0.5), F.lit(3.5), F.lit(True)))).filter(F.col("ts") <= end)
    cols = ["pair", "ts", "spread", "spread_z", "signal"]
    a, b = (x.select(*cols).orderBy("pair", "ts").toPandas() for x in (got, want))
    assert len(a) == len(b) > 1000 and (a["signal"] == b["signal"]).all()
    assert np.allclose(a[["spread", "spread_z"]].astype(float), b[["spread", "spread_z"]].astype(float), equal_nan=True)


def test_account_limits(spark, tmp_path):
    """Two accounts, three pairs, several bars a day, repeated rows and missing values: K1 to K8 as in the batch."""
    rng, rows = np.random.default_rng(2), []
    for account, pairs in (("x", ("a", "b")), ("y", ("c",))):
        for pair in pairs:
            equity = 1.0
            for i in range(120):
                pnl = float(rng.normal(0, 0.012))
                equity += pnl
                rows.append((account, pair, dt.datetime(2024, 1, 1) + dt.timedelta(hours=12 * i), pnl, equity, float(rng.normal()), 1.0, 0.2, 0.1))
    df = spark.createDataFrame(rows, "account string, pair string, ts timestamp, pnl double, equity double, fx_position double, comd_position double, fx_price double, comd_price double")
    slices = [df.filter((F.dayofyear("ts") > lo) & (F.dayofyear("ts") <= lo + 20)).orderBy(F.rand(3)) for lo in (0, 20, 40)]
    limits = K.Limits(cooldown_days=3, max_drawdown=0.05)
    got, late = feed(spark, tmp_path, lambda t: live.live_account_risk(t, limits, 2.0, "1 day"), slices)
    assert late == 0
    got = got.orderBy("account", "pair", "ts").toPandas()
    assert len(got) == 3 * 118 and not got.duplicated(["pair", "ts"]).any()
    for account in ("x", "y"):
        mine = df.filter(F.col("account") == account)
        peak = F.max("equity").over(S.PAIR.running())
        batch = mine.withColumn("seg", F.lit(0)).withColumn("drawdown", F.col("equity") / peak - 1)
        batch = K.daily_drawdown(K.loss_flags(K.period_pnl(batch), limits), limits.daily_drawdown)
        batch = batch.join(K.exposure(mine, 2.0, limits.total_exposure), "ts").orderBy("account", "pair", "ts").toPandas()
        stream = got[got["account"] == account].reset_index(drop=True)
        batch = batch.merge(stream[["pair", "ts"]], on=["pair", "ts"]).sort_values(["pair", "ts"]).reset_index(drop=True)
        for c in ("daily_pnl", "weekly_pnl", "account_daily", "account_weekly", "exposure"):
            assert np.allclose(stream[c], batch[c]), c
        for c in ("drawdown_breach", "daily_breach", "weekly_breach", "account_daily_breach", "account_weekly_breach", "day_drawdown_breach", "exposure_breach"):
            assert (stream[c] == batch[c]).all(), c
        # the breaker, bar by bar: from the trigger on, for three days with the trigger's own
        halted, want = None, {}
        for ts, day in batch.groupby("ts"):
            if day["daily_breach"].any():
                halted = ts.normalize() + dt.timedelta(days=2)
            want[ts] = halted is not None and ts.normalize() <= halted
        active = stream["ts"].map(want)
        assert (stream["breaker_active"] == active).all() and 0 < active.mean() < 1
        breached = stream[[c for c in stream if c.endswith("_breach") and c != "exposure_breach"]].any(axis=1)
        assert (stream["can_trade"] == ~(active | breached)).all()


def test_missing_values_and_ties(spark, tmp_path):
    """A bar without prices keeps the previous spread; rows of one time come in a fixed order; no rows give none."""
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    rows = [("p", at(0), None, 1.0), ("p", at(1), 1.2, 50.0), ("p", at(2), None, 50.0), ("p", at(3), 1.3, 51.0), ("p", at(3), 1.3, 51.0), ("p", at(9), 1.0, 50.0)]
    df = spark.createDataFrame(rows, "pair string, ts timestamp, fx_price double, comd_price double")
    got, _ = feed(spark, tmp_path, lambda t: live.live_signals(t, late="2 days"), [df.limit(0), df.orderBy(F.desc("ts"))])
    got = got.orderBy("ts").collect()
    assert [r.ts.day for r in got] == [1, 2, 3, 4, 4]
    assert got[0].spread is None and got[1].spread == got[2].spread


@pytest.mark.parametrize("stake", [1.0])
def test_breaker_ends_with_event_time(stake):
    """A halt lasts until its last day has passed, whatever comes in between."""
    import pandas as pd

    rule = live.AccountRisk(K.Limits(cooldown_days=2), stake)
    state, seen = rule.begin(), []
    for day, pnl in ((1, -0.5), (2, 0.0), (3, 0.0), (10, 0.0)):
        state, out = rule.advance(("m",), state, pd.Timestamp(2024, 1, day), [("p", pnl, 0.0, pnl, pnl, 0.0, 0.0)])
        seen.append(out[0][-2])
    assert seen == [True, True, False, False]
