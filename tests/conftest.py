import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", master="local[4]", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def make_bars(symbol="AAA", n=300, seed=42, start="2015-01-01", freq="B"):
    rng = np.random.default_rng(seed)
    close = 100 * np.cumprod(1 + np.linspace(1e-4, 5e-4, n) + rng.normal(0, 0.01, n))
    open_ = close * (1 + rng.normal(0, 0.002, n))
    high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, 0.003, n)))
    low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, 0.003, n)))
    return pd.DataFrame({"symbol": symbol, "timestamp": pd.date_range(start, periods=n, freq=freq), "open": open_, "high": high, "low": low, "close": close,
                         "volume": rng.integers(2_000_000, 20_000_000, n).astype(float)})


@pytest.fixture(scope="session")
def bars_pdf():
    """One long series and one short one."""
    return pd.concat([make_bars("AAA", 900, 42), make_bars("BBB", 120, 7)], ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    return spark.createDataFrame(bars_pdf).cache()
