import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as bt, signals as sig
from tests.conftest import collect, make_bars


def flags(n=900, seed=3):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"symbol": "A", "ts": pd.date_range("2000-01-01", periods=n).date, "close": 100 + rng.normal(0, 1, n).cumsum() * 0.1,
                         "long": rng.random(n) < 0.15, "short": rng.random(n) < 0.15})


def loop(pdf, short_state):
    pos, out = 0, []
    for lo, sh in zip(pdf.long, pdf.short):
        if lo and pos <= 0:
            pos = 1
        elif sh and pos >= 0:
            pos = short_state
        out.append(pos)
    return out


@pytest.mark.parametrize("short_state", [0, -1])
def test_state_machine_equals_the_loop(spark, short_state):
    pdf = flags()
    got = collect(bt.state_position(spark.createDataFrame(pdf), short_state), "ts")
    assert got.position.tolist() == loop(pdf, short_state)


def test_hold_position_prefers_long(spark):
    pdf = flags()
    got = collect(bt.hold_position(spark.createDataFrame(pdf)), "ts")
    pos, want = 0, []
    for lo, sh in zip(pdf.long, pdf.short):
        pos = 1 if lo else 0 if sh else pos
        want.append(pos)
    assert got.position.tolist() == want


def test_strategy_returns_use_the_previous_position(spark):
    pdf = flags(50)
    pdf["position"] = loop(pdf, 0)
    got = collect(bt.strategy_returns(spark.createDataFrame(pdf), cost=0.001, capital=10.0), "ts")
    pos = pdf.position
    want = pos.shift(1).fillna(0) * pdf.close.pct_change().fillna(0) - pos.diff().abs().fillna(0) * 0.001
    np.testing.assert_allclose(got.ret, want, atol=1e-15)
    np.testing.assert_allclose(got.equity, 10 * (1 + want).cumprod(), rtol=1e-12)


def test_closed_trades_match_the_loop(spark):
    pdf = flags(300)
    pdf["position"] = loop(pdf, -1)
    got = collect(bt.closed_trades(spark.createDataFrame(pdf)), "entry_bar")
    trades, pos, entry = [], 0, None
    for i, (p, c) in enumerate(zip(pdf.position, pdf.close)):
        if p != pos:
            if pos != 0:
                trades.append((entry[0], i, (c - entry[1]) * pos / entry[1]))
            entry, pos = (i, c), p
    assert list(zip(got.entry_bar, got.exit_bar)) == [(a, b) for a, b, _ in trades]
    np.testing.assert_allclose(got.pnl_pct, [t[2] for t in trades], rtol=1e-12)


def ema(s, n):
    return s.ewm(span=n, adjust=False, min_periods=n).mean()


def test_temacd_matches_pandas(spark):
    pdf = make_bars(("A",), 600, gaps=False)
    got = collect(sig.temacd_conditions(spark.createDataFrame(pdf)), "ts")
    c = pdf.close
    macd = ema(c, 61) - ema(c, 70)
    delta = macd - ema(macd, 15)
    np.testing.assert_allclose(got.delta.astype(float), delta, rtol=1e-6, atol=1e-10)
    lines = [ema(c, 5), ema(c, 50), ema(c, 222)]
    long = (delta > 0) & (delta.shift(1) <= 0)
    short = (delta < 0) & (delta.shift(1) >= 0)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        x, y = lines[a], lines[b]
        long |= (x > y) & (x.shift(1) <= y.shift(1))
        short |= (x < y) & (x.shift(1) >= y.shift(1))
    assert got.long.tolist() == long.tolist() and got.short.tolist() == short.tolist()


@pytest.mark.parametrize("n,rows", [(50, 0), (249, 0), (250, 1), (400, 1)])
def test_screener_needs_250_bars(spark, n, rows):
    assert sig.screener(spark.createDataFrame(make_bars(("A",), n, gaps=False))).count() == rows


def test_combined_signals(spark):
    df = spark.createDataFrame([("A", 1, "x", 1), ("A", 1, "y", -1), ("A", 1, "z", -1), ("A", 2, "x", 1), ("A", 2, "y", 1), ("A", 2, "z", 1)],
                               "symbol string, ts int, strategy string, signal int")
    got = {m: [r.signal for r in sig.combine(df, m).orderBy("ts").collect()] for m in ("or", "and", "majority")}
    assert got == {"or": [1, 1], "and": [0, 1], "majority": [-1, 1]}
    with pytest.raises(ValueError):
        sig.combine(df, "xor")


def test_signal_precedence(spark):
    df = spark.createDataFrame([("A", 1, True, True)], "symbol string, ts int, long boolean, short boolean")
    assert sig.signal_table(df, "long").first().signal == 1 and sig.signal_table(df, "short").first().signal == -1


def test_lots_guard(spark):
    row = spark.range(1).select(bt.lots(F.lit(1000.0), 0.2, F.lit(0.0), F.lit(10.0), F.lit(1.0)).alias("a"),
                                bt.lots(F.lit(1000.0), 0.2, F.lit(0.4), F.lit(10.0), F.lit(5.0)).alias("b")).first()
    assert row.a == 0.0 and row.b == pytest.approx(10.0)
