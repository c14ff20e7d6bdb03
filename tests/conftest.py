import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "barloom-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def walk():
    """Seeded random-walk bars of three symbols, one much longer than the others."""
    rng = np.random.default_rng(7)
    frames = []
    for symbol, n in (("HOT", 900), ("AA", 150), ("BB", 70)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = np.concatenate([[100.0], close[:-1]])
        high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.01, n))
        low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.01, n))
        frames.append(pd.DataFrame({
            "symbol": symbol, "ts": pd.date_range("2020-01-01", periods=n, freq="D"),
            "open": open_, "high": high, "low": low, "close": close,
            "volume": rng.uniform(1, 100, n)}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def walk_df(spark, walk):
    return spark.createDataFrame(walk).cache()
