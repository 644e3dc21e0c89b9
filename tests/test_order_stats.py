"""Sliding order statistics and exact quantiles against plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlake.functions import order_stats
from spreadlake.functions import rolling as R
from spreadlake.operators import metrics


@pytest.mark.parametrize("values", [1, 3, 10_000])
def test_rank_tree(values):
    rng = np.random.default_rng(values)
    x = rng.integers(0, values, 400) / 7
    tree = order_stats.RankTree(x)
    begin = rng.integers(0, 399, 300)
    end = begin + 1 + rng.integers(0, 400, 300) % (400 - begin)
    k = rng.integers(0, 1 << 20, 300) % (end - begin)
    assert all(got == np.sort(x[a:b])[i] for got, a, b, i in zip(tree.kth(begin, end, k), begin, end, k))
    centre = tree.median(begin, end)
    assert all(c == np.median(x[a:b]) for c, a, b in zip(centre, begin, end))
    for middle in (centre, x[k], np.full(300, 1e6), np.full(300, -1e6)):
        near = tree.nearest(begin, end, middle, k)
        assert all(got == np.sort(np.abs(x[a:b] - c))[i] for got, a, b, c, i in zip(near, begin, end, middle, k))


def bars(spark, n=900, ties=False):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=n), 1 if ties else 9)
    rows = [("a" if i % 3 else "b", 0, i, None if i % 41 == 5 else float(v), i) for i, v in enumerate(x)] + [("c", 0, 0, None, 0), ("d", 0, 1, 2.5, 0)]
    return spark.createDataFrame(rows, "pair string, seg int, ts int, v double, _extra int")


@pytest.mark.parametrize("ties", [False, True])
def test_sliding_frames_equal_sorted_arrays(spark, ties):
    """Nulls inside frames, ties, short series and an empty table: the same values as from the sorted arrays."""
    df = bars(spark, ties=ties)
    got = order_stats.with_median(df, "v", 120, "m", least=20)
    got = order_stats.with_quantiles(got, "v", 25, {"q1": 1 / 3, "q2": 0.5, "q3": 1.0})
    got = got.withColumns({"m_": R.median(F.col("v"), 120, least=20)} | {f"{q}_": R.full(R.PAIR.last(25), 25, F.col("v"), F.percentile("v", F.lit(p))) for q, p in (("q1", 1 / 3), ("q2", 0.5), ("q3", 1.0))})
    assert got.count() == df.count()
    assert got.filter("NOT (m <=> m_ AND q1 <=> q1_ AND q2 <=> q2_ AND q3 <=> q3_)").count() == 0
    assert got.filter("m IS NOT NULL").count() > 700 and got.filter("q1 IS NOT NULL").count() > 50
    assert order_stats.with_median(df.limit(0), "v", 5, "m").count() == 0


def test_robust_z_long_and_short(spark, monkeypatch):
    df = bars(spark).filter("v IS NOT NULL")
    short = R.with_robust_z(df, "v", 60, "z").select("pair", "ts", F.col("z").alias("short"))
    monkeypatch.setattr(order_stats, "LONG", 2)
    both = R.with_robust_z(df, "v", 60, "z").join(short, ["pair", "ts"])
    assert both.filter("NOT (z <=> short)").count() == 0 and both.filter("z IS NOT NULL").count() > 700


def test_quantiles_with_ties(spark):
    """A third of all rows with one value is one row after the map side; results are exact."""
    rng = np.random.default_rng(5)
    series = {
        "tied": np.where(np.arange(30_000) % 3 == 0, 0.25, rng.normal(size=30_000)), "one": np.full(5000, -1.5), "few": rng.integers(0, 4, 999) * 1.0,
        "single": np.array([7.0]), "wide": rng.normal(size=20_000) ** 5, "zeros": np.array([0.0, -0.0] * 40),
    }
    rows = [(k, float(v)) for k, x in series.items() for v in x] + [("tied", None), ("tied", float("nan")), ("none", None)]
    probs = {"lo": 0.01, "a": 0.05, "mid": 0.5, "b": 0.95, "top": 1.0}
    got = {r["pair"]: r for r in metrics.quantiles(spark.createDataFrame(rows, "pair string, x double"), "x", probs).collect()}
    assert set(got) == set(series)
    for k, x in series.items():
        assert all(got[k][name] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-15) for name, p in probs.items()), k
    assert metrics.quantiles(spark.createDataFrame([], "pair string, x double"), "x", probs).count() == 0
