"""Cross-fitting: one prediction per row, by a model that has seen neither the row nor a label window that touches its block."""

import datetime as dt

import numpy as np
import pytest

from pyspark.sql import functions as F
from spreadlake.operators import crossfit
from spreadlake.operators import models as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(400):
        for pair in ("a", "b"):
            x = float(rng.normal())
            ts = dt.datetime(2021, 1, 1) + dt.timedelta(days=i)
            out.append((pair, ts, ts + dt.timedelta(days=5), x, float(rng.normal()), float(x + rng.normal() > 0), 2 * x + float(rng.normal(0, 0.1)), 1))
    return spark.createDataFrame(out, "pair string, ts timestamp, label_end timestamp, x double, z double, label double, y double, signal int").cache()


def test_blocks_are_even_and_training_rows_purged(spark, rows):
    starts = crossfit.boundaries(rows, 4)
    assert len(starts) == 3
    sizes = [r.n for r in rows.groupBy(crossfit.block_of(starts, F.col("ts")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sorted(sizes) == [200] * 4
    for k in range(4):
        train = crossfit.training_rows(rows, starts, k, embargo_days=3).toPandas()
        low = starts[k - 1] if k else None
        high = starts[k] if k < 3 else None
        inside = train["ts"].dt.date.map(lambda d: (low is None or d >= low) and (high is None or d < high))
        assert len(train) and not inside.any()
        if low:
            before = train[train["ts"].dt.date < low]
            assert (before["label_end"].dt.date < low).all() and (not len(before) or before["label_end"].dt.date.max() == low - dt.timedelta(days=1))
        if high:
            after = train[train["ts"].dt.date >= high]
            assert not len(after) or after["ts"].dt.date.min() == high + dt.timedelta(days=8)  # five days of labels, three of embargo


def test_every_row_once_by_a_model_of_other_rows(spark, rows):
    scored, models = crossfit.cross_fit(rows, lambda t: L.fit_linear(t, ["x", "z"], "y", "p"), lambda m, t: m.transform(t).drop("features"), folds=4)
    got = scored.toPandas()
    assert len(models) == 4 and len(got) == 800 and not got.duplicated(["pair", "ts"]).any()
    plain = rows.toPandas()
    starts = crossfit.boundaries(rows, 4)
    for k in range(4):
        train = crossfit.training_rows(rows, starts, k).toPandas()
        a = np.column_stack([np.ones(len(train)), train["x"], train["z"]])
        coef = np.linalg.lstsq(a, train["y"], rcond=None)[0]
        mine = got[got["fold"] == k]
        assert np.allclose(mine["p"], coef[0] + coef[1] * mine["x"] + coef[2] * mine["z"], atol=1e-6)
    assert len(plain) == len(got)


def test_filter_and_report(spark, rows):
    out, models = crossfit.cross_fit(rows, lambda t: L.fit_filter(t, ["x", "z"]), L.apply_filter, folds=2)
    got = out.toPandas()
    assert len(got) == 800 and ((got["p_win"] > 0.5) == (got["label"] == 1)).mean() > 0.65
    scored, models = crossfit.cross_fit(rows, lambda t: L.fit_linear(t, ["x", "z"], "y", "p"), lambda m, t: m.transform(t).drop("features"), folds=2)
    told = L.report(scored.withColumn("q", F.lit(0.0)), "y", ["p", "q"], L.mean_importance(models, ["x", "z"], scored, "p")).toPandas()
    assert len(told) == 6 and set(told["model"]) == {"p", "q"}
    best = told[(told["model"] == "p") & (told["feature"] == "x")]
    assert (best["r2"] > 0.98).all() and (best["importance"] > 1.9).all() and told[told["model"] == "q"]["feature"].isna().all()


def test_too_little_to_learn_from(spark, rows):
    with pytest.raises(ValueError, match="two days"):
        crossfit.cross_fit(rows.filter("ts = timestamp'2021-01-01'"), None, None)
    with pytest.raises(ValueError, match="nothing is left"):
        crossfit.cross_fit(rows.filter("ts < timestamp'2021-01-05'"), lambda t: L.fit_linear(t, ["x"], "y"), lambda m, t: m.transform(t), folds=2)
