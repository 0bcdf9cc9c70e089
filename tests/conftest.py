import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "4", shuffle_partitions=4, driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


def make_bars(symbols=("A", "B", "C"), n=700, seed=1, gaps=True):
    """Daily bars with gaps; the first symbol has all days and thus most rows."""
    rng = np.random.default_rng(seed)
    frames = []
    for k, s in enumerate(symbols):
        days = pd.date_range("2000-01-03", periods=n, freq="D")
        if gaps and k:
            days = days[np.sort(rng.choice(n, size=n // (k + 1), replace=False))]
        close = 100 * np.cumprod(1 + rng.normal(0.0005, 0.02, len(days)))
        spread = np.abs(rng.normal(0, 0.5, len(days)))
        frames.append(pd.DataFrame({
            "symbol": s, "ts": days.date, "open": close * (1 + rng.normal(0, 0.003, len(days))),
            "high": close + spread, "low": close - spread, "close": close,
            "volume": rng.integers(1, 1000, len(days)).astype(float)}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def bars_pd():
    return make_bars()


@pytest.fixture(scope="session")
def bars(spark, bars_pd):
    return spark.createDataFrame(bars_pd)


def collect(df, *order):
    """Result as pandas, sorted."""
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)
