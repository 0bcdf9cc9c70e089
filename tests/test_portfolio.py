import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import portfolio as pf, rotation as rot, panel as pn
from tests.conftest import collect, make_bars


def returns_frame(n=120, k=7, seed=5, missing=0.1):
    rng = np.random.default_rng(seed)
    r = pd.DataFrame(rng.normal(0.001, 0.02, (n, k)), columns=[f"S{i}" for i in range(k)])
    r = r.mask(rng.random((n, k)) < missing)
    long = r.reset_index(names="d").melt("d", var_name="symbol", value_name="ret").dropna()
    return r, long


def test_covariance_is_pairwise_complete_across_tiles(spark):
    wide, long = returns_frame()
    moments = pf.pair_moments(spark.createDataFrame(long), tile=2, chunk=16)
    n = F.col("n")
    got = collect(moments.select("a", "b", ((F.col("sxy") - F.col("sx") * F.col("sy") / n) / (n - 1)).alias("c")), "a", "b")
    cov = wide.cov()
    assert len(got) == 28
    np.testing.assert_allclose(got.c, [cov.loc[a, b] for a, b in zip(got.a, got.b)], rtol=1e-9)


def block(spark, cov, mu):
    names = [f"S{i}" for i in range(len(mu))]
    rows = [("t", a, b, float(cov[i, j]), float(mu[i])) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return spark.createDataFrame(rows, "ts string, a string, b string, cov double, mean double")


def test_risk_parity_equalises_risk(spark):
    cov = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    w = collect(pf.risk_parity(block(spark, cov, np.zeros(3)), iterations=400), "symbol").weight.to_numpy()
    risk = w * (cov @ w)
    np.testing.assert_allclose(risk, risk.mean(), rtol=1e-9)
    assert w.sum() == pytest.approx(1.0)
    flat = collect(pf.risk_parity(block(spark, np.zeros((2, 2)), np.zeros(2)), 0.1), "symbol").weight.tolist()
    assert flat == pytest.approx([0.45, 0.45])
    with pytest.raises(ValueError):
        pf.risk_parity(block(spark, cov, np.zeros(3)), damping=1.0)


def test_linear_systems_of_several_dates(spark):
    """Definite, indefinite and singular matrices are solved side by side by products alone."""
    rng = np.random.default_rng(0)
    a = rng.normal(size=(9, 9))
    q = np.linalg.qr(a)[0]
    mats = {"p": a @ a.T + np.eye(9), "q": q @ np.diag([5, -4, 3, -2, 1, 1, 2, 0.5, -0.1]) @ q.T, "s": q @ np.diag([1.0] * 8 + [0]) @ q.T}
    names = [f"S{i}" for i in range(9)]
    rows = [(d, names[i], names[j], float(m[i, j])) for d, m in mats.items() for i in range(9) for j in range(i, 9)]
    m = pf.RowMatrix(spark.createDataFrame(rows, "ts string, a string, b string, cov double"), ["ts"])
    b = rng.normal(size=9)
    got = pf.solve(m, {(d,): b for d in mats})
    np.testing.assert_allclose(got["p",], np.linalg.solve(mats["p"], b), rtol=1e-7)
    np.testing.assert_allclose(got["q",], np.linalg.solve(mats["q"], b), rtol=1e-7)
    assert got["s",] is None


def test_kelly_matches_numpy_and_survives_a_singular_block(spark):
    cov = np.array([[0.04, 0.01], [0.01, 0.09]])
    mu = np.array([0.03, 0.02])
    got = collect(pf.kelly(block(spark, cov, mu), 0.5, 0.1), "symbol").weight.to_numpy()
    w = np.clip(np.linalg.solve(cov, mu) * 0.5, 0, None)
    w = w / w.sum() * 0.9 if w.sum() > 1 else w
    np.testing.assert_allclose(got, w / w.sum() * 0.9, rtol=1e-12)
    flat = collect(pf.kelly(block(spark, np.zeros((2, 2)), mu), 0.5), "symbol").weight.tolist()
    assert flat == [0.5, 0.5]


@pytest.mark.parametrize("missing", [0.0, 0.02])
def test_risk_of_returns_with_and_without_gaps(spark, missing):
    """With few gaps some symbols take the way without pairs; the pairwise-complete matrix gives the same."""
    wide, long = returns_frame(n=40, missing=missing, seed=8)
    assert missing == 0 or 0 < wide.isna().any().sum() < 7
    w = pd.Series(np.arange(1.0, 8) / 28, index=wide.columns)
    sw = wide.cov().fillna(0) @ w * 252
    got = collect(pf.risk_contributions(spark.createDataFrame(long), spark.createDataFrame(w.rename("weight").rename_axis("symbol").reset_index())), "symbol")
    vol = np.sqrt(w @ sw)
    np.testing.assert_allclose(got.mrc, sw / vol, rtol=1e-9)
    assert got.crc.sum() == pytest.approx(vol) and got.crc_pct.sum() == pytest.approx(1.0)


def test_weights_sum_to_one_minus_cash(spark):
    v = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (1, "c", 0.0), (2, "a", 0.3)], "ts int, symbol string, vol double")
    for fn in (pf.inverse_volatility, pf.volatility_targeting):
        got = fn(v, cash=0.2).groupBy("ts").agg(F.sum("weight").alias("s")).collect()
        assert all(r.s == pytest.approx(0.8) for r in got)


def test_exposure_and_turnover_match_a_dense_grid(spark):
    rng = np.random.default_rng(0)
    dense = pd.DataFrame(rng.normal(size=(12, 3)), columns=list("abc")).mask(rng.random((12, 3)) < 0.4).fillna(0)
    long = dense.reset_index(names="d").melt("d", var_name="symbol", value_name="weight")
    long = long[long.weight != 0]
    cal = spark.createDataFrame(pd.DataFrame({"d": range(12), "ts": range(12)}))
    got = collect(pf.exposure_turnover(spark.createDataFrame(long), cal), "d").set_index("d")
    turn = dense.diff().abs().sum(axis=1)
    turn.iloc[0] = dense.iloc[0].abs().sum()
    for d in got.index:
        assert got.exposure[d] == pytest.approx(dense.abs().sum(axis=1)[d], abs=1e-12)
        assert got.turnover[d] == pytest.approx(turn[d], abs=1e-12)


def test_panel_fills_forward_like_pandas(spark):
    pdf = make_bars(("A", "B", "C"), 90)
    got = collect(pn.panel(spark.createDataFrame(pdf), ("close",)), "symbol", "ts")
    wide = pdf.pivot(index="ts", columns="symbol", values="close").sort_index().ffill()
    want = wide.reset_index().melt("ts", var_name="symbol", value_name="close").dropna().sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert got.symbol.tolist() == want.symbol.tolist() and got.ts.tolist() == want.ts.tolist()
    np.testing.assert_allclose(got.close, want.close)
    before = want.groupby("symbol").close.shift(1)
    np.testing.assert_allclose(got._pc, before)


def test_average_correlation_matches_pandas_with_tiny_tiles(spark):
    pdf = make_bars(tuple("ABCDE"), 80)
    p = pn.panel(spark.createDataFrame(pdf), ("close",))
    got = collect(rot.average_correlation(p, window=15, min_rows=10, tile=2, chunk=20), "d", "symbol")
    wide = pdf.pivot(index="ts", columns="symbol", values="close").sort_index().ffill()
    rets = wide.pct_change()
    for d, symbol, avg in got[["d", "symbol", "avg_corr"]].itertuples(index=False):
        c = rets.iloc[max(0, d - 15):d + 1].corr()[symbol].drop(symbol).dropna()
        assert avg == pytest.approx(c.mean() if len(c) else 0.0, abs=1e-8)


def test_ensemble_ignores_disabled_strategies(spark):
    w = spark.createDataFrame([("x", "a", 1, 1, 1.0, 1), ("y", "b", 1, 1, 1.0, 1)], "strategy string, symbol string, ts int, d int, weight double, signal int")
    meta = spark.createDataFrame([("x", 1.0)], "strategy string, meta_weight double")
    assert [(r.symbol, r.weight) for r in rot.ensemble(w, meta).collect()] == [("a", 1.0)]
