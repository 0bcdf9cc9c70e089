import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import features as feat
from tests.conftest import collect


def rolled(close, n, fn):
    return close.rolling(n).apply(fn, raw=True)


def worst(x):
    return (x / np.maximum.accumulate(x) - 1).min()


EXPECTED = {
    "momentum": (feat.momentum(30), lambda g: g.close / g.close.shift(30) - 1),
    "cagr": (feat.rolling_cagr(63), lambda g: (g.close / g.close.shift(63)) ** 4 - 1),
    "vol": (feat.rolling_volatility(20), lambda g: g.close.pct_change().rolling(20).std() * np.sqrt(252)),
    "mdd": (feat.rolling_max_drawdown(40), lambda g: rolled(g.close, 40, worst)),
    "sharpe": (feat.rolling_sharpe(30), lambda g: g.close.pct_change().rolling(30).mean() / g.close.pct_change().rolling(30).std() * np.sqrt(252)),
    "z": (feat.z_score(20), lambda g: (g.close - g.close.rolling(20).mean()) / g.close.rolling(20).std()),
    "pct": (feat.percentile_rank(25), lambda g: rolled(g.close, 25, lambda x: pd.Series(x).rank(pct=True).iloc[-1] * 100)),
    "mdd1": (feat.rolling_max_drawdown(1), lambda g: g.close * 0),
    "mdd7": (feat.rolling_max_drawdown(7), lambda g: rolled(g.close, 7, worst)),
    "own": (feat.rolling_apply(9, lambda x, n: np.convolve(x, np.arange(1, n + 1)[::-1])[:len(x)]), lambda g: rolled(g.close, 9, lambda x: (x * np.arange(1, 10)).sum())),
    "sma": (feat.sma(15), lambda g: g.close.rolling(15).mean()),
}


def strength(g, n=14):
    """RSI of each window of n rows from its sums of gains and losses; the first row of a series has no move."""
    close, out = g.close.to_numpy(), np.full(len(g), 50.0)
    for t in range(n - 1, len(close)):
        moves = np.diff(close[max(0, t - n):t + 1])
        gain, loss = sum(m for m in moves if m > 0), -sum(m for m in moves if m < 0)
        if loss:
            out[t] = 100 * gain / (gain + loss)
    return pd.Series(out, index=g.index)


EXPECTED["rsi"] = (feat.rsi(14), strength)


def test_window_ranks_count_every_window():
    x = np.random.default_rng(4).integers(0, 9, 200).astype(float)
    for n in (1, 2, 13, 300):
        less, equal = feat.window_ranks(x, n)
        for t in range(len(x)):
            seen = x[max(0, t - n + 1):t + 1]
            assert (less[t], equal[t]) == ((seen < x[t]).sum(), (seen == x[t]).sum())


def test_kernels_leave_windows_with_gaps_out(spark):
    x = [1.0, 3.0, None, 2.0, 5.0, 4.0, 4.0]
    df = spark.createDataFrame([("A", i, float(i), v) for i, v in enumerate(x)], "symbol string, _i bigint, ts double, close double")
    got = collect(feat.compute(df, {"p": feat.percentile_rank(3), "d": feat.rolling_max_drawdown(3)}, size=2), "ts")
    assert got.p.isna().tolist() == [True] * 5 + [False] * 2 and got.p[5:].tolist() == pytest.approx([200 / 3, 50.0])
    assert got.d.isna().tolist() == [True] * 5 + [False] * 2 and got.d[5:].tolist() == pytest.approx([-0.2, -0.2])


@pytest.mark.parametrize("size", [32, 2048])
def test_features_match_pandas(bars, bars_pd, size):
    got = collect(feat.compute(bars, {n: f for n, (f, _) in EXPECTED.items()}, size=size), "symbol", "ts")
    exp = bars_pd.sort_values(["symbol", "ts"]).reset_index(drop=True)
    for name, (_, fn) in EXPECTED.items():
        want = pd.concat([fn(g) for _, g in exp.groupby("symbol")])
        np.testing.assert_allclose(got[name].astype(float), want.astype(float), rtol=1e-7, atol=1e-9, err_msg=name)


def test_no_value_changes_when_later_rows_are_removed(bars):
    fs = {n: f for n, (f, _) in EXPECTED.items()} | {"atr": feat.atr(14), "adx": feat.adx(14)}
    cutoff = F.lit("2001-03-01").cast("date")
    full = collect(feat.compute(bars, fs).where(F.col("ts") <= cutoff), "symbol", "ts")
    early = collect(feat.compute(bars.where(F.col("ts") <= cutoff), fs), "symbol", "ts")
    pd.testing.assert_frame_equal(full, early)


def test_cross_sectional_rank_averages_ties(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 2.0), ("d", 1, None)], "symbol string, ts int, x double")
    got = {r.symbol: r.cs_rank for r in feat.cross_sectional_rank(df, "x").collect()}
    assert got["d"] is None
    assert got["a"] == pytest.approx(100 / 3) and got["b"] == got["c"] == pytest.approx(250 / 3)


def test_unknown_feature_and_bad_window():
    with pytest.raises(ValueError):
        feat.feature("nope")
    with pytest.raises(ValueError):
        feat.rolling_volatility(1)


def test_user_feature_can_be_registered(bars):
    feat.REGISTRY["range"] = lambda n: feat.Feature(n, lambda df, w, name: df.withColumn(
        name, F.max("high").over(w.rowsBetween(-(n - 1), 0)) - F.min("low").over(w.rowsBetween(-(n - 1), 0))), ("high", "low"))
    try:
        out = feat.compute(bars, {"r": feat.feature("range", 5)})
        assert out.where(F.col("r") < 0).count() == 0
    finally:
        del feat.REGISTRY["range"]
