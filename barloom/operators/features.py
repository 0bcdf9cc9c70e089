"""Rolling features per series, computed together over one block layout.

Each feature names the number of earlier rows it needs. ``compute`` takes the
largest, splits the series once and evaluates all features on the same window,
so any number of features costs one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from barloom.functions.scalars import TRADING_DAYS, change, clip, crossed_down, crossed_up, ratio
from barloom.operators.timeline import (
    blocks, ema_blocks, ema_input, emas, ewm_std, ewm_std_specs, full, index_bars, linear_scan, own, pick, scan, window)
from barloom.schema import require
from barloom.session import cut

ANNUAL = float(TRADING_DAYS) ** 0.5


@dataclass(frozen=True)
class Feature:
    """``build`` adds the named column to a blocked frame; temporaries start with '_f_'.

    A feature with ``kernel`` instead computes its column from the array of its
    first needed column, one block of rows with history at a time.
    """
    lookback: int
    build: Callable[[DataFrame, WindowSpec, str], DataFrame] | None
    needs: tuple[str, ...] = ("close",)
    kernel: Callable[[np.ndarray], np.ndarray] | None = None


def _simple(lookback: int, expr: Callable[[WindowSpec], Column], *needs: str) -> Feature:
    return Feature(lookback, lambda df, w, name: df.withColumn(name, expr(w)), needs or ("close",))


def _positive(n: int, least: int = 1) -> int:
    if n < least:
        raise ValueError(f"window must be at least {least}")
    return n


def _with_ret(df: DataFrame, w: WindowSpec) -> DataFrame:
    if "_f_ret" in df.columns:
        return df
    before = F.col("_pc") if "_pc" in df.columns else F.lag("close").over(w)
    return df.withColumn("_f_ret", change(F.col("close"), before))


def momentum(n: int = 252) -> Feature:
    _positive(n)
    return _simple(n, lambda w: change(F.col("close"), F.lag("close", n).over(w)))


def skip_momentum(n: int = 252, skip: int = 21) -> Feature:
    """Return over n rows ending ``skip`` rows ago."""
    return _simple(n + skip, lambda w: change(F.lag("close", skip).over(w), F.lag("close", n + skip).over(w)))


def rsi(n: int = 14) -> Feature:
    """RSI from simple means of gains and losses; undefined values become 50."""
    _positive(n)

    def build(df, w, name):
        d = F.col("close") - F.lag("close").over(w)
        df = df.withColumns({
            f"_f_up_{name}": F.when(d > 0, d).otherwise(0.0),
            f"_f_dn_{name}": F.when(d < 0, -d).otherwise(0.0)})
        up, dn = F.col(f"_f_up_{name}"), F.col(f"_f_dn_{name}")
        rs = ratio(full(F.avg(up), up, n, w), full(F.avg(dn), dn, n, w))
        return df.withColumn(name, F.coalesce(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs), F.lit(50.0)))
    return Feature(n, build)


def rolling_cagr(n: int = 252) -> Feature:
    _positive(n, 2)
    return _simple(n, lambda w: F.pow(ratio(F.col("close"), F.lag("close", n).over(w)),
                                      F.lit(TRADING_DAYS / n)) - F.lit(1.0))


def rolling_volatility(n: int = 20) -> Feature:
    _positive(n, 2)

    def build(df, w, name):
        df = _with_ret(df, w)
        return df.withColumn(name, full(F.stddev_samp("_f_ret"), F.col("_f_ret"), n, w) * F.lit(ANNUAL))
    return Feature(n, build)


def rolling_max_drawdown(n: int = 252) -> Feature:
    """Deepest fall below an earlier price of the window, for positive prices.

    A sparse table: highest, lowest and deepest fall over the last 1, 2, 4, ... rows
    follow from the rows half as far back, and the window is put together from
    one such piece per binary digit of ``n``, so a row costs log n steps.
    """
    _positive(n)

    def build(df, w, name):
        def back(k: int, steps: int) -> tuple[Column, ...]:
            return tuple(F.lag(f"_f_{x}{k}_{name}", steps).over(w) if steps else F.col(f"_f_{x}{k}_{name}") for x in ("hi", "lo", "dd"))

        def joined(old: tuple[Column, ...], new: tuple[Column, ...]) -> tuple[Column, ...]:
            return F.greatest(old[0], new[0]), F.least(old[1], new[1]), F.least(old[2], new[2], change(new[1], old[0]))

        def put(df, k: int, values: tuple[Column, ...]):
            return df.withColumns({f"_f_{x}{k}_{name}": v for x, v in zip(("hi", "lo", "dd"), values, strict=True)})

        close = F.col("close")
        df = put(df, 0, (close, close, F.when(close.isNotNull(), 0.0)))
        for k in range(n.bit_length() - 1):
            df = put(df, k + 1, joined(back(k, 1 << k), back(k, 0)))
        at, total = 0, None
        for k in range(n.bit_length()):  # newest piece first
            if n >> k & 1:
                piece = back(k, at)
                total = piece if total is None else joined(piece, total)
                at += 1 << k
        return df.withColumn(name, F.when(F.count("close").over(w.rowsBetween(-(n - 1), 0)) == n, total[2]))
    return Feature(n, build)


def rolling_calmar(n: int = 252) -> Feature:
    def build(df, w, name):
        df = rolling_max_drawdown(n).build(df, w, f"_f_mdd_{name}")
        df = rolling_cagr(n).build(df, w, f"_f_cagr_{name}")
        return df.withColumn(name, ratio(F.col(f"_f_cagr_{name}"), F.abs(F.col(f"_f_mdd_{name}"))))
    return Feature(n, build)


def true_range(w: WindowSpec) -> Column:
    pc = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def atr(n: int = 14) -> Feature:
    def build(df, w, name):
        df = df.withColumn("_f_tr", true_range(w))
        return df.withColumn(name, full(F.avg("_f_tr"), F.col("_f_tr"), n, w))
    return Feature(n, build, ("high", "low", "close"))


def adx(n: int = 14) -> Feature:
    """Directional index from simple means, smoothed once more over n."""
    def build(df, w, name):
        up = F.col("high") - F.lag("high").over(w)
        down = F.lag("low").over(w) - F.col("low")
        df = df.withColumns({
            "_f_tr": true_range(w),
            "_f_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "_f_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0)})
        tr, p, m = F.col("_f_tr"), F.col("_f_pdm"), F.col("_f_mdm")
        rng = full(F.avg(tr), tr, n, w)
        df = df.withColumns({
            "_f_pdi": F.lit(100.0) * ratio(full(F.avg(p), p, n, w), rng),
            "_f_mdi": F.lit(100.0) * ratio(full(F.avg(m), m, n, w), rng)})
        pdi, mdi = F.col("_f_pdi"), F.col("_f_mdi")
        df = df.withColumn("_f_dx", ratio(F.lit(100.0) * F.abs(pdi - mdi), pdi + mdi))
        return df.withColumn(name, full(F.avg("_f_dx"), F.col("_f_dx"), n, w))
    return Feature(2 * n, build, ("high", "low", "close"))


def sma(n: int, column: str = "close") -> Feature:
    _positive(n)
    return _simple(n, lambda w: full(F.avg(column), F.col(column), n, w), column)


def _ma_pair(fast: int, slow: int, cross) -> Feature:
    def build(df, w, name):
        f, s = f"_f_fast_{name}", f"_f_slow_{name}"
        df = sma(slow).build(sma(fast).build(df, w, f), w, s)
        return df.withColumn(name, cross(F.col(f), F.col(s), F.lag(f).over(w), F.lag(s).over(w)))
    return Feature(slow, build)


def golden_cross(fast: int = 50, slow: int = 200) -> Feature:
    return _ma_pair(fast, slow, crossed_up)


def death_cross(fast: int = 50, slow: int = 200) -> Feature:
    return _ma_pair(fast, slow, crossed_down)


def z_score(n: int = 20, column: str = "close") -> Feature:
    _positive(n, 2)

    def expr(w):
        x = F.col(column)
        return ratio(x - full(F.avg(x), x, n, w), full(F.stddev_samp(x), x, n, w))
    return _simple(n, expr, column)


def return_z_score(n: int = 20) -> Feature:
    def build(df, w, name):
        return z_score(n, "_f_ret").build(_with_ret(df, w), w, name)
    return Feature(n, build)


def rolling_sharpe(n: int = 60) -> Feature:
    _positive(n, 2)

    def build(df, w, name):
        df = _with_ret(df, w)
        x = F.col("_f_ret")
        return df.withColumn(name, ratio(full(F.avg(x), x, n, w), full(F.stddev_samp(x), x, n, w)) * F.lit(ANNUAL))
    return Feature(n, build)


def rolling_sortino(n: int = 60) -> Feature:
    """Mean over the std of the negative returns; over the plain std when fewer than two are negative."""
    _positive(n, 2)

    def build(df, w, name):
        df = _with_ret(df, w)
        x = F.col("_f_ret")
        frame = w.rowsBetween(-(n - 1), 0)
        down = F.when(x < 0, x)
        risk = F.when(F.count(down).over(frame) > 1, F.stddev_samp(down).over(frame)).otherwise(
            F.stddev_samp(x).over(frame))
        return df.withColumn(name, ratio(full(F.avg(x), x, n, w), risk) * F.lit(ANNUAL))
    return Feature(n, build)


def rolling_apply(n: int, fn: Callable[[np.ndarray, int], np.ndarray], column: str = "close") -> Feature:
    """Hook for a rolling function of the user's own, vectorised over a block of rows.

    ``fn(values, n)`` gets a block of a series with its history, NULL as NaN, and
    returns one value per row; the value of a row may depend on that row and the
    n - 1 before it. Rows without ``n`` values in their window are NULL whatever ``fn``
    returns for them.
    """
    _positive(n)

    def kernel(x: np.ndarray) -> np.ndarray:
        known = np.concatenate([[0], np.cumsum(~np.isnan(x))])
        here = np.arange(1, len(x) + 1)
        whole = known[here] - known[np.maximum(here - n, 0)] == n
        return np.where(whole, fn(x, n), np.nan)
    return Feature(n - 1, None, (column,), kernel)


def _with_kernel(df: DataFrame, keys: tuple[str, ...], name: str, f: Feature) -> DataFrame:
    schema = T.StructType([*df.drop(name).schema, T.StructField(name, T.DoubleType())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_i")
        x = rows.column(f.needs[0]).cast(pa.float64()).to_numpy()
        return rows.append_column(name, pa.array(f.kernel(x), pa.float64(), from_pandas=True))

    return df.drop(name).groupBy(*keys, "_b").applyInArrow(run, schema)  # a block is bounded


def window_ranks(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the last ``n`` values (fewer at the start) are below and equal to each value.

    Ranks are cut into bits. From the highest bit on, values are dealt by their bit
    with order kept, so a window stays a range; where a value has a one, the
    window's zeros are below it. A row costs one step per bit, whatever ``n``.
    """
    rank = np.unique(x, return_inverse=True)[1]
    hi = np.arange(1, len(x) + 1)
    lo = np.maximum(hi - n, 0)
    less = np.zeros(len(x), np.int64)
    dealt = rank
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        zero = dealt >> bit & 1 == 0
        zeros = np.concatenate([[0], np.cumsum(zero)])
        a, b = zeros[lo], zeros[hi]
        one = rank >> bit & 1 == 1
        less += np.where(one, b - a, 0)
        lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        dealt = np.concatenate([dealt[zero], dealt[~zero]])
    return less, hi - lo


def percentile_rank(n: int = 252, column: str = "close") -> Feature:
    """Average-rank percentile (0-100) of the newest value in its window."""
    def kernel(x: np.ndarray, n: int) -> np.ndarray:
        less, equal = window_ranks(x, n)
        return (less + (equal + 1) / 2.0) / n * 100.0
    return rolling_apply(n, kernel, column)


def donchian(entry: int = 20, exit: int = 10, high: str = "high", low: str = "low") -> Feature:
    """``<name>_upper``/``<name>_lower``: channel of the preceding bars."""
    def build(df, w, name):
        up, dn = w.rowsBetween(-entry, -1), w.rowsBetween(-exit, -1)
        return df.withColumns({
            f"{name}_upper": F.when(F.count(high).over(up) == entry, F.max(high).over(up)),
            f"{name}_lower": F.when(F.count(low).over(dn) == exit, F.min(low).over(dn))})
    return Feature(max(entry, exit), build, tuple({high, low}))


def overnight_score(n: int = 504) -> Feature:
    """Mean over n rows of overnight minus intraday return."""
    def build(df, w, name):
        overnight = change(F.col("open"), F.lag("close").over(w))
        df = df.withColumn("_f_on", overnight - change(F.col("close"), F.col("open")))
        return df.withColumn(name, full(F.avg("_f_on"), F.col("_f_on"), n, w))
    return Feature(n, build, ("open", "close"))


# name -> builder: the feature catalogue; extend with REGISTRY["mine"] = fn
REGISTRY: dict[str, Callable[..., Feature]] = {
    "momentum": momentum, "skip_momentum": skip_momentum, "rsi": rsi, "rolling_cagr": rolling_cagr,
    "rolling_volatility": rolling_volatility, "rolling_max_drawdown": rolling_max_drawdown,
    "rolling_calmar": rolling_calmar, "atr": atr, "adx": adx, "sma": sma,
    "golden_cross": golden_cross, "death_cross": death_cross, "z_score": z_score,
    "return_z_score": return_z_score, "rolling_sharpe": rolling_sharpe,
    "rolling_sortino": rolling_sortino, "percentile_rank": percentile_rank,
    "donchian": donchian, "overnight_score": overnight_score,
}


def feature(name: str, *args, **kwargs) -> Feature:
    if name not in REGISTRY:
        raise ValueError(f"unsupported feature {name}")
    return REGISTRY[name](*args, **kwargs)


def compute(bars: DataFrame, features: dict[str, Feature], keys=("symbol",), order: str = "ts",
            size: int = 2048, keep_index: bool = False) -> DataFrame:
    """Add every feature to ``bars`` in one pass over a shared block layout."""
    for f in features.values():
        require(bars, *[c for c in f.needs if not c.startswith("_f_")])
    lookback = max(f.lookback for f in features.values())
    df = blocks(bars, lookback, size=size, keys=keys, order=order)
    w = window(keys)
    for name, f in features.items():
        if f.kernel:
            df = _with_kernel(df, keys, name, f)
    for name, f in features.items():
        if f.build:
            df = f.build(df, w, name)
    df = own(df, drop_index=not keep_index)
    return df.drop(*[c for c in df.columns if c.startswith("_f_")])


# ------------------------------------------------------------ simple per-row

def returns(bars: DataFrame, keys=("symbol",), order: str = "ts", price: str = "close",
            name: str = "ret") -> DataFrame:
    """Simple returns; the first row of a series is NULL."""
    known = "_pc" in bars.columns and price == "close"
    out = bars if known else scan(bars, {"_pc": ("prev", F.col(price))}, keys, order)
    return out.withColumn(name, change(F.col(price), F.col("_pc"))).drop("_pc")


def ema(bars: DataFrame, spans: dict[str, int], warmup: bool = False, keys=("symbol",),
        order: str = "ts", column: str = "close") -> DataFrame:
    df = ema_blocks(bars.where(F.col(column).isNotNull()), keys, order)
    return own(emas(df, {n: (F.col(column), s) for n, s in spans.items()}, warmup, keys))


def resample_last(bars: DataFrame, unit: str = "month") -> DataFrame:
    """Last price per calendar unit."""
    return bars.groupBy("symbol", F.date_trunc(unit, "ts").cast("date").alias("period")).agg(
        F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))


def ewmac(bars: DataFrame, fast: int = 32, slow: int = 128, vol_span: int = 25, cap: float = 20.0) -> DataFrame:
    """Trend forecast (fast EMA - slow EMA) / weighted std of price changes, clipped."""
    if "_pc" not in bars.columns:
        bars = index_bars(bars)
    df = ema_blocks(bars)
    close = F.col("close")
    df = linear_scan(df, {"_ef": ema_input(close, fast), "_es": ema_input(close, slow),
                          **ewm_std_specs(close - F.col("_pc"), vol_span, start=1)})
    raw = ratio(F.col("_ef") - F.col("_es"), ewm_std(start=1))
    df = df.withColumn("forecast", F.coalesce(clip(raw, -cap, cap), F.lit(0.0)))
    return own(df.drop("_ef", "_es", "_w", "_v", "_x", "_q"))


# --------------------------------------------------------- against a benchmark

def join_benchmark(bars: DataFrame, symbol: str, columns: dict[str, str]) -> DataFrame:
    """Inner join on ts with one symbol's columns (source -> new name).

    One row per ts: Catalyst broadcasts it only when the runtime size allows.
    """
    bench = bars.where(F.col("symbol") == symbol).select(
        "ts", *[F.col(c).alias(n) for c, n in columns.items()])
    return bars.drop("_i", "_pc").join(bench, "ts")


def relative_strength(bars: DataFrame, benchmark: str = "SPY", name: str = "rs") -> DataFrame:
    df = join_benchmark(pick(bars, "close"), benchmark, {"close": "bench_close"})
    return df.select("symbol", "ts", ratio(F.col("close"), F.col("bench_close")).alias(name))


def beta_correlation(rets: DataFrame, n: int = 60, keys=("symbol",), x: str = "ret", y: str = "bench_ret",
                     size: int = 2048) -> DataFrame:
    """Rolling beta and correlation of two aligned return columns."""
    df = blocks(rets, n, size=size, keys=keys)
    w = window(keys)
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.lit(1.0))
    df = df.withColumns({
        "rolling_beta": ratio(full(F.covar_samp(x, y), both, n, w), full(F.var_samp(y), F.col(y), n, w)),
        "rolling_corr": full(F.corr(x, y), both, n, w)})
    return own(df)


def rolling_benchmark(bars: DataFrame, benchmark: str = "SPY", n: int = 60) -> DataFrame:
    """Rolling beta and correlation of each symbol to a benchmark symbol."""
    rets = returns(pick(bars, "close"))
    joined = join_benchmark(rets, benchmark, {"ret": "bench_ret"})
    return beta_correlation(cut(joined), n).select("symbol", "ts", "rolling_beta", "rolling_corr")


# ----------------------------------------------------------------- cross section

def cross_sectional_rank(df: DataFrame, column: str, name: str = "cs_rank", by=("ts",)) -> DataFrame:
    """Average-rank percentile per date (0-100), NULL values unranked.

    The number of ranked symbols is a map-side combined count joined back; the
    window streams over one date, which holds each symbol once.
    """
    by = list(by)
    x = F.col(column)
    w = Window.partitionBy(*by).orderBy(column)
    # the RANGE frame counts up to the last peer, so ties = count - rank + 1
    sizes = df.where(x.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    live = df.where(x.isNotNull()).withColumns({"_r": F.rank().over(w), "_t": F.count(F.lit(1)).over(
        w.rangeBetween(Window.unboundedPreceding, 0))})
    live = live.withColumn("_t", F.col("_t") - F.col("_r") + 1).join(sizes, by)
    live = live.withColumn(name, (F.col("_r") + (F.col("_t") - 1) / F.lit(2.0)) / F.col("_n") * F.lit(100.0))
    dead = df.where(x.isNull()).withColumn(name, F.lit(None).cast("double"))
    return live.drop("_r", "_t", "_n").unionByName(dead)
