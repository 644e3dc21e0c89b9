"""Rounded results are those of the SQL where the double lies a little beside a half."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from spreadlake.functions import rolling as R

NAMES = ["p1_pct_change", "p4_clip", "p5_replace_fill"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(5)
    before = rng.choice([1.28, 3.2, 3.84, 6.4], 2000)  # a price over one of these has a seventh decimal of five
    price = np.column_stack([before, rng.integers(1, 4000, 2000) / 100]).ravel()
    at = pd.date_range("2024-01-01", periods=len(price), freq="min").astype("datetime64[us]")
    out = tmp_path_factory.mktemp("halves")
    pd.DataFrame({"event_id": range(len(price)), "ts": at, "user_id": 1, "event_type": "a", "value": price}).to_parquet(out / "events.parquet")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_halves_of_the_last_place(spark, folder, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df = entry.queries()[name](spark, folder)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = duck.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]}) ORDER BY event_id").fetchall()
    assert sorted(map(tuple, df.collect()), key=lambda r: r[1]) == want


def test_rounded_on_odd_values(spark):
    odd = [None, 0.5, -0.5, 2.5, 0.49999999999999994, 4.1234375, -4.1234375, 1e-320, 1e15 + 0.3, 2.0**53 + 2, 1.7e308, -1.7e308, float("inf"), float("-inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, v double")
    for places in (0, 2, 6, 10):
        got = [r.x for r in df.select("i", R.rounded(df.v, places).alias("x")).orderBy("i").collect()]
        assert got == [duckdb.execute(f"SELECT round(CAST(? AS DOUBLE), {places})", [v]).fetchone()[0] for v in odd]
    assert np.isnan(spark.range(1).select(R.rounded(R.F.lit(float("nan")), 6).alias("x")).first().x)


def test_share_beside_a_half(spark, tmp_path):
    price = [1.0] * 60 + [100.0, 1.0] * 290  # 41 of 640 rows are quiet
    at = pd.date_range("2024-01-01", periods=len(price), freq="min").astype("datetime64[us]")
    pd.DataFrame({"event_id": range(len(price)), "ts": at, "user_id": 1, "event_type": "a", "value": price}).to_parquet(tmp_path / "events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = duck.execute(f"SELECT pair, state, n, share FROM ({entry.oracle_sql()['p11_value_shares']}) ORDER BY state").fetchall()
    assert [r[2] for r in want] == [41, 19, 580]
    got = entry.queries()["p11_value_shares"](spark, str(tmp_path)).select("pair", "state", "n", "share").collect()
    assert sorted(map(tuple, got)) == want
