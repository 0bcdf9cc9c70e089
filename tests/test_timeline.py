import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import timeline as tl, universe as uni
from barloom.session import cut
from tests.conftest import collect


def by_symbol(pdf, fn):
    return pdf.sort_values(["symbol", "ts"]).groupby("symbol", group_keys=False).apply(fn).reset_index(drop=True)


@pytest.mark.parametrize("days", [3, 50, 5000])
def test_scan_matches_pandas_for_any_block_width(spark, bars, bars_pd, days):
    block = tl.time_block("ts", days)
    odd = F.when(F.col("volume") % 2 == 1, F.col("close"))
    got = collect(tl.scan(bars, {
        "s": ("sum", F.col("volume")), "n": ("count", F.lit(1)), "hi": ("max", F.col("close")), "lo": ("min", F.col("close")),
        "p": ("product", F.lit(1) + F.col("volume") / 1e6), "l": ("last", odd), "before": ("prev", F.col("close")),
        "after": ("next", F.col("close"))}, block=block), "symbol", "ts")

    def want(g):
        return g.assign(s=g.volume.cumsum(), n=np.arange(1, len(g) + 1), hi=g.close.cummax(), lo=g.close.cummin(),
                        p=(1 + g.volume / 1e6).cumprod(), l=g.close.where(g.volume % 2 == 1).ffill(),
                        before=g.close.shift(1), after=g.close.shift(-1))
    exp = by_symbol(bars_pd, want)
    for c in ("s", "n", "hi", "lo", "p", "l", "before", "after"):
        np.testing.assert_allclose(got[c].astype(float), exp[c].astype(float), rtol=1e-12, err_msg=c)


def test_number_is_dense_and_independent_of_partitioning(bars):
    a = collect(tl.number(bars, days=7), "symbol", "ts")
    b = collect(tl.number(bars.repartition(13, "volume"), days=7), "symbol", "ts")
    assert a["_i"].tolist() == b["_i"].tolist()
    for _, g in a.groupby("symbol"):
        assert g["_i"].tolist() == list(range(len(g)))


@pytest.mark.parametrize("size", [5, 16, 4096])
def test_rolling_frames_are_exact_for_any_block_size(bars, bars_pd, size):
    df = tl.blocks(bars, lookback=20, size=size)
    w = tl.window()
    df = df.withColumn("m", tl.full(F.avg("close"), F.col("close"), 20, w)).withColumn("far", F.lag("close", 20).over(w))
    got = collect(tl.own(df), "symbol", "ts")
    exp = by_symbol(bars_pd, lambda g: g.assign(m=g.close.rolling(20).mean(), far=g.close.shift(20)))
    assert len(got) == len(exp)
    np.testing.assert_allclose(got["m"], exp["m"], rtol=1e-12)
    np.testing.assert_allclose(got["far"], exp["far"], rtol=1e-12)


@pytest.mark.parametrize("span", [2, 5, 50, 222])
def test_ema_matches_pandas(bars, bars_pd, span):
    df = tl.emas(tl.ema_blocks(bars), {"e": (F.col("close"), span)})
    df = df.withColumn("prev", F.lag("e").over(tl.window()))
    got = collect(tl.own(df), "symbol", "ts")
    exp = by_symbol(bars_pd, lambda g: g.assign(e=g.close.ewm(span=span, adjust=False).mean()))
    np.testing.assert_allclose(got["e"], exp["e"], rtol=1e-11)
    prev = exp.groupby("symbol")["e"].shift(1)
    np.testing.assert_allclose(got["prev"], prev, rtol=1e-11)


def test_ewm_std_matches_pandas(bars, bars_pd):
    ix = tl.index_bars(bars)
    df = tl.linear_scan(tl.ema_blocks(ix), tl.ewm_std_specs(F.col("close") - F.col("_pc"), 25, start=1))
    got = collect(tl.own(df.withColumn("sd", tl.ewm_std(1))), "symbol", "ts")
    exp = by_symbol(bars_pd, lambda g: g.assign(sd=g.close.diff().ewm(span=25).std()))
    np.testing.assert_allclose(got["sd"], exp["sd"], rtol=1e-8)


def test_unknown_scan_kind_is_rejected(bars):
    with pytest.raises(ValueError):
        tl.scan(bars, {"x": ("median", F.col("close"))})


def test_ema_of_span_one_is_its_input(bars, bars_pd):
    df = tl.own(tl.emas(tl.ema_blocks(tl.index_bars(bars)), {"e": (F.col("close"), 1)}))
    got = collect(df, "symbol", "ts")
    np.testing.assert_array_equal(got["e"], got["close"])
    with pytest.raises(ValueError):
        tl.ema_input(F.col("close"), 0)


def test_ema_forgets_huge_values_exactly(spark):
    values = np.r_[np.full(50, 1e12), np.ones(6000)]
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2000-01-01", periods=len(values)).date, "close": values})
    df = tl.own(tl.emas(tl.ema_blocks(tl.index_bars(spark.createDataFrame(pdf))), {"e": (F.col("close"), 222)}))
    got = collect(df, "symbol", "ts")["e"]
    np.testing.assert_allclose(got, pdf.close.ewm(span=222, adjust=False).mean(), rtol=1e-9)


def test_intraday_bars_get_narrow_blocks(spark, bars):
    minutes = spark.range(6000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("symbol"),
                                       F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("close"))
    days = tl.block_days(minutes, rows=100)
    assert 0.05 < days < 0.15 and tl.block_days(bars) == tl.BLOCK_DAYS
    blocks = minutes.groupBy("symbol", tl.time_block("ts", days)).count().agg(F.max("count")).first()[0]
    assert 60 <= blocks <= 130
    got = collect(tl.index_bars(minutes), "symbol", "ts")
    for _, g in got.groupby("symbol"):
        assert g._i.tolist() == list(range(len(g))) and g._pc.tolist()[1:] == g.close.tolist()[:-1]


def test_universe_spans_are_the_daily_verdicts(spark, bars):
    """Spans, sizes and members against one verdict per symbol and day, with and without metadata."""
    limits = uni.Limits(min_history=30, min_avg_volume=1, min_notional=1, min_aum=2_000_000, max_spread=0.012, max_turnover=1.05, max_tracking_error=9, benchmark="A")
    meta = spark.createDataFrame([("A", None, dt.date(2001, 3, 1), None, None), ("B", dt.date(2000, 9, 1), None, 1e9, 0.1), ("C", None, None, 1.0, None)],
                                 "symbol string, listing date, delisting date, aum double, tracking_error double")
    days = F.sequence(F.lit("2000-01-01").cast("date"), F.lit("2002-02-01").cast("date"))
    dates = spark.range(1).select(F.explode(days).alias("as_of"))
    for metadata in (None, meta):
        spans = cut(uni.inclusion_spans(bars, limits, metadata))
        daily = uni.snapshots(uni.checks(bars, days, limits, metadata))
        want = {(r.as_of, r.symbol) for r in daily.where("included").collect()}
        rows = spans.collect()
        assert {(r.since + dt.timedelta(k), r.symbol) for r in rows for k in range((r.until - r.since).days + 1)} == want and len(want) > 100
        assert {(r.as_of, r.symbol) for r in uni.members_at(spans, dates, bucket_days=37).collect()} == want
        sizes = {r.as_of: r["size"] for r in uni.size_over_time(spans, dates).collect()}
        assert len(sizes) == dates.count() and all(sizes[d] == sum(x == d for x, _ in want) for d in list(sizes)[::17])
