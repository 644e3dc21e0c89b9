"""The models of all folds are fitted at the same time, and stay with their folds."""

import datetime as dt
import threading

from spreadlake.operators import crossfit
from spreadlake.operators import models as L


def test_folds_are_fitted_together(spark):
    day = dt.datetime(2021, 1, 1)
    rows = [(day + dt.timedelta(days=i), day + dt.timedelta(days=i), float(i % 7), 3.0 * (i % 7) + 1) for i in range(90)]
    df = spark.createDataFrame(rows, "ts timestamp, label_end timestamp, x double, y double")
    all_here = threading.Barrier(3, timeout=60)

    def fit(train):
        all_here.wait()
        return L.fit_linear(train, ["x"], "y", "p")

    out, models = crossfit.cross_fit(df, fit, lambda m, t: m.transform(t).drop("features"), folds=3)
    got = out.toPandas()
    assert len(models) == 3 and sorted(got["fold"].unique()) == [0, 1, 2] and len(got) == 90
    assert (got["p"] - got["y"]).abs().max() < 1e-6
