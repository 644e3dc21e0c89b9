import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spreadlake.session import build_session

    session = build_session("8", extra={"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def pairs(spark):
    """Two pairs of 700 daily bars with identical times, kept as pandas rows."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    frames = []
    for pair in ("p", "q"):
        x = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, 700)))
        y = 1.2 * x**0.4 + rng.normal(0, 0.05, 700)
        frames.append(pd.DataFrame({"pair": pair, "ts": pd.date_range("2020-01-01", periods=700), "fx_price": y, "comd_price": x}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, pairs):
    return spark.createDataFrame(pairs.sample(frac=1.0, random_state=1)).cache()
