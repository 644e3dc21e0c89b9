"""Queries on ticks against their SQL where prices are zero: changes from them are infinite, of two zeros not a number."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

NAMES = ["p1_pct_change", "p2_log_return", "p4_clip", "p5_replace_fill", "p11_value_shares", "p12_transition_matrix"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(3)
    price = rng.uniform(1, 9, 200)
    price[[30, 31, 90, 150]] = 0.0
    at = pd.date_range("2024-01-01", periods=200, freq="min").astype("datetime64[us]")
    out = tmp_path_factory.mktemp("ticks")
    pd.DataFrame({"event_id": range(200), "ts": at, "user_id": 1, "event_type": ["a", "b"] * 100, "value": price}).to_parquet(out / "events.parquet")
    return str(out)


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)


@pytest.mark.parametrize("name", NAMES)
def test_zero_prices(spark, folder, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df = entry.queries()[name](spark, folder)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    got = sorted(map(tuple, df.collect()), key=lambda r: r[:2])
    want = sorted(duck.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall(), key=lambda r: r[:2])
    assert len(got) == len(want) > 0
    assert all(same(a, b) for x, y in zip(got, want) for a, b in zip(x, y))
