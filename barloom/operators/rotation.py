"""Rotation strategies: decision-date weights on the calendar panel.

Every strategy maps a panel (``operators.panel``) to sparse rows
``(symbol, d, weight, signal)``; ``finish`` moves them to the next calendar bar
and normalises where the strategy asks for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.functions.scalars import change, ratio
from barloom.operators import features as feat
from barloom.operators.packed import each_run
from barloom.operators.panel import next_bar
from barloom.operators.timeline import attach, ema_blocks, emas, index_bars, own
from barloom.plans import dims
from barloom.session import cut

VIX_NAMES = ("^VIX", "VIX", "VIXY")  # fixed values: volatility index symbols by preference


def pick_top(scores: DataFrame, n: int | None = None, share: Callable[[Column], Column] | None = None,
             descending: bool = True, by: str = "d") -> DataFrame:
    """Best rows per date; ``share`` maps the number of scored rows to n.

    Ties go to the smaller symbol. With a fixed n Spark limits each map
    partition to n rows per date before the shuffle.
    """
    order = F.col("score").desc_nulls_last() if descending else F.col("score").asc_nulls_last()
    if n is None:
        sizes = scores.groupBy(by).agg(F.greatest(F.lit(1), share(F.count(F.lit(1)))).alias("_n"))
        scores = scores.join(sizes, by)
        limit = F.col("_n")
    else:
        limit = F.lit(n)
    w = Window.partitionBy(by).orderBy(order, "symbol")
    top = scores.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= limit)
    return top.withColumn("_held", F.count(F.lit(1)).over(Window.partitionBy(by))).drop("_rk", "_n")


def _equal(top: DataFrame) -> DataFrame:
    return top.select("symbol", "d", (F.lit(1.0) / F.col("_held")).alias("weight"), F.lit(1).alias("signal"))


def _scored(p: DataFrame, f: feat.Feature) -> DataFrame:
    df = feat.compute(p, {"score": f})
    return df.where(F.col("score").isNotNull()).select("symbol", "d", F.round("score", 10).alias("score"))


def rsi_rotation(p: DataFrame, top_n: int = 5, window: int = 14) -> DataFrame:
    return _equal(pick_top(_scored(p, feat.rsi(window)), top_n))


def momentum_rotation(p: DataFrame, top_n: int = 5, lookback: int = 252, skip: int = 21) -> DataFrame:
    return _equal(pick_top(_scored(p, feat.skip_momentum(lookback, skip)), top_n))


def _equal_share(held: DataFrame) -> DataFrame:
    """Equal weight over the rows of a date."""
    n = held.groupBy("d").agg(F.count(F.lit(1)).alias("_held"))
    return _equal(held.select("symbol", "d").join(n, "d"))


def _above(a: str, b: str) -> Column:
    """a > b beyond rounding: an EMA of a constant stretch must count as equal to it."""
    return F.round(F.col(a) - F.col(b), 9) > 0


def golden_cross(p: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    df = own(emas(ema_blocks(p), {"_f": (F.col("close"), fast), "_s": (F.col("close"), slow)}))
    return _equal_share(df.where(_above("_f", "_s")))


def _symbols(p: DataFrame) -> DataFrame:
    return p.select("symbol").distinct()


def _basket(p: DataFrame, states: DataFrame, strategy: str) -> DataFrame:
    """states(d, state) to basket weights over the symbols present in the panel."""
    spark = p.sparkSession
    rows = [r[1:] for r in dims.BASKETS if r[0] == strategy]
    basket = dims.frame(spark, rows, "state string, symbol string, weight double").join(_symbols(p), "symbol", "left_semi")
    return states.join(F.broadcast(basket), "state").select("symbol", "d", "weight", F.lit(1).alias("signal"))


def _dates(p: DataFrame) -> DataFrame:
    return p.select("d").distinct()


def ratio_rotation(p: DataFrame, strategy: str, first: str, second: str, span: int = 20) -> DataFrame:
    """Basket by whether the ratio of two symbols is above its EMA; no data, no weights."""
    a = p.where(F.col("symbol") == first).select("symbol", "d", "ts", F.col("close").alias("_a"))
    b = p.where(F.col("symbol") == second).select("d", F.col("close").alias("_b"))
    pair = index_bars(a.join(b, "d").select("symbol", "ts", "d", ratio(F.col("_a"), F.col("_b")).alias("close")))
    df = own(emas(ema_blocks(pair), {"_ma": (F.col("close"), span)})).select("d", _above("close", "_ma").alias("_up"))
    some = pair.agg((F.count(F.lit(1)) > 0).alias("_some"))
    states = attach(_dates(p), some).where("_some").join(df, "d", "left")
    state = F.when(F.coalesce(F.col("_up"), F.lit(False)), "rising").otherwise("falling")
    return _basket(p, states.select("d", state.alias("state")), strategy)


def volatility_level(p: DataFrame) -> DataFrame:
    """(d, vix): the preferred index symbol's close, else 20-bar realised SPY volatility."""
    names = dims.frame(p.sparkSession, [(s, i) for i, s in enumerate(VIX_NAMES)], "symbol string, _prio int")
    chosen = _symbols(p).join(F.broadcast(names), "symbol").agg(F.min_by("symbol", "_prio").alias("_chosen"))
    df = attach(p.where(F.col("symbol").isin(*VIX_NAMES, "SPY")), chosen)
    level = df.where(F.col("symbol") == F.col("_chosen")).select("d", F.col("close").alias("vix"))
    spy = feat.compute(df.where(F.col("_chosen").isNull() & (F.col("symbol") == "SPY")),
                       {"_v": feat.rolling_volatility(20)})
    return level.unionByName(spy.select("d", (F.col("_v") * 100).alias("vix")))


def vix_rotation(p: DataFrame, low: float = 18, high: float = 30) -> DataFrame:
    states = _dates(p).join(volatility_level(p), "d", "left")
    state = F.when(F.col("vix") < low, "low").when(F.col("vix") >= high, "high").otherwise("mid")
    return _basket(p, states.select("d", state.alias("state")), "VIX_Rotation")


def hedging(p: DataFrame, threshold: float = 25) -> DataFrame:
    states = volatility_level(p).where(F.col("vix") > threshold).select("d", F.lit("high").alias("state"))
    return _basket(p, states, "Hedging_System")


def managed_futures(p: DataFrame, span: int = 200, share: float = 0.6) -> DataFrame:
    """Trend basket when enough symbols are above their EMA; trending symbols get a signal only."""
    df = own(emas(ema_blocks(p), {"_ma": (F.col("close"), span)}))
    df = cut(df.select("symbol", "d", _above("close", "_ma").alias("_up")))
    total = _symbols(p).agg(F.count(F.lit(1)).alias("_total"))
    up = df.groupBy("d").agg(F.count_if("_up").alias("_ups"))
    state = F.when(F.col("_ups") > F.col("_total") * share, "trend").otherwise("flat")
    basket = _basket(p, attach(up, total).select("d", state.alias("state")), "Managed_Futures_Rotation")
    trending = df.where("_up").select("symbol", "d", F.lit(0.0).alias("weight"), F.lit(1).alias("signal"))
    return basket.unionByName(trending).groupBy("symbol", "d").agg(
        F.sum("weight").alias("weight"), F.max("signal").alias("signal"))


def volatility_rotation(p: DataFrame, window: int = 20, part: int = 5) -> DataFrame:
    scores = _scored(p, feat.rolling_volatility(window))
    return _equal(pick_top(scores, share=lambda n: F.floor(n / part), descending=False))


def _series(p: DataFrame, window: int, chunk: int) -> DataFrame:
    """(chunk, symbol, x, here, gappy): returns of one symbol over a chunk of dates and the ``window`` before it, packed.

    ``x`` has NaN where there is no return, ``here`` marks the symbol's rows, ``gappy`` is
    set if any return is missing.
    """
    r = p.select("symbol", "d", change(F.col("close"), F.col("_pc")).alias("ret"))
    spread = F.sequence(F.floor(F.col("d") / chunk), F.floor((F.col("d") + window) / chunk))
    rows = r.withColumn("chunk", F.explode(spread)).groupBy("chunk", "symbol").agg(
        F.collect_list(F.col("d").cast("bigint")).alias("_d"), F.collect_list(F.coalesce("ret", F.lit(float("nan")))).alias("_x"))  # one per date at most
    width = chunk + window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, heres, gaps = [], [], []
            for c, d, v in zip(b.column("chunk").to_pylist(), b.column("_d"), b.column("_x"), strict=True):
                at = d.values.to_numpy() - (c * chunk - window)
                x, here = np.full(width, np.nan), np.zeros(width, bool)
                x[at] = v.values.to_numpy()
                here[at] = True
                xs.append(x.tobytes())
                heres.append(here.tobytes())
                gaps.append(bool(np.isnan(x).any()))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("symbol"), pa.array(xs, pa.binary()), pa.array(heres, pa.binary()), pa.array(gaps, pa.bool_())],
                                             names=["chunk", "symbol", "x", "here", "gappy"])

    packed = rows.mapInArrow(run, "chunk bigint, symbol string, x binary, here binary, gappy boolean")
    return cut(packed.repartitionByRange("chunk", "symbol").sortWithinPartitions("chunk", "symbol"))


def _windows(x: np.ndarray, size: int) -> np.ndarray:
    """Every window of ``size`` values in units of its own spread; zeros where a value is missing or the window is flat."""
    w = np.lib.stride_tricks.sliding_window_view(x, size)
    away = w - w.mean(axis=1, keepdims=True)
    squares = (away * away).sum(axis=1, keepdims=True)
    live = squares > 1e-12 * (w * w).sum(axis=1, keepdims=True)  # False for NaN
    return np.where(live, away / np.sqrt(np.where(live, squares, 1.0)), 0.0)


def average_correlation(p: DataFrame, window: int = 60, min_rows: int = 20, tile: int = 32, chunk: int = 256, salt: int = 2000) -> DataFrame:
    """Mean pairwise-complete correlation of each symbol with all others per date.

    Where no return of a window is missing, a symbol's correlations with all
    others add up to its standardised returns times the sum of everybody's: one
    pass adds up the standardised windows of a chunk of dates, a second one
    multiplies each symbol with that sum, and no two symbols ever meet. Only
    pairs with a symbol that has gaps in the chunk are worked on as pairs, in
    tiles of both, and only on dates on which one of the two has a gap.
    """
    size = window + 1
    series = _series(p, window, chunk)
    shape = (chunk, size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, n = None, np.zeros(shape), np.zeros(chunk)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())],
                                              names=["chunk", "total", "n"])
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("x").to_pylist(), strict=True):
                if c != at and at is not None:
                    yield done()
                if c != at:
                    at, total, n = c, np.zeros(shape), np.zeros(chunk)
                z = _windows(np.frombuffer(x), size)
                total += z
                n += z.any(axis=1)
        if at is not None:
            yield done()

    def joined(key: dict, rows: pa.Table) -> Iterator[dict]:
        yield {c: sum(np.frombuffer(v) for v in rows.column(c).to_pylist()).tobytes() for c in ("total", "n")}

    partial = series.select("chunk", "x").mapInArrow(add, "chunk bigint, total binary, n binary")
    whole = each_run(partial, ["chunk"], joined, "total binary, n binary")
    salts = series.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / salt).alias("_salts"))
    own = whole.join(salts, "chunk").select("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)).alias("part"), F.lit(None).cast("string").alias("symbol"), "total", "n")
    rows = series.join(salts, "chunk").select("chunk", F.pmod(F.xxhash64("symbol"), F.col("_salts")).alias("part"), "symbol", "x", "here")

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = n = None
        for b in batches:
            out = {"symbol": [], "d": [], "total": [], "n": []}
            for c, symbol, t, k, x, here in zip(*[b.column(c).to_pylist() for c in ("chunk", "symbol", "total", "n", "x", "here")], strict=True):
                if symbol is None:
                    total, n = np.frombuffer(t).reshape(shape), np.frombuffer(k)
                    continue
                z = _windows(np.frombuffer(x), size)
                live = z.any(axis=1)
                days = np.flatnonzero(np.frombuffer(here, bool)[window:])
                out["symbol"] += [symbol] * len(days)
                out["d"] += (c * chunk + days).tolist()
                out["total"] += np.where(live, (z * total).sum(axis=1) - 1.0, 0.0)[days].tolist()
                out["n"] += np.where(live, n - 1, 0)[days].astype(int).tolist()
            yield pa.RecordBatch.from_pydict(out, pa.schema([("symbol", pa.string()), ("d", pa.int64()), ("total", pa.float64()), ("n", pa.int64())]))

    both = own.unionByName(rows, allowMissingColumns=True).repartition("chunk", "part").sortWithinPartitions("chunk", "part", F.col("symbol").asc_nulls_first())
    sums = both.mapInArrow(times, "symbol string, d bigint, total double, n bigint")
    if not series.where("gappy").isEmpty():
        sums = sums.unionByName(_gap_pairs(series, window, tile, chunk))
    return sums.where(F.col("d") >= min_rows - 1).groupBy("symbol", "d").agg(
        F.coalesce(F.try_divide(F.sum("total"), F.sum("n")), F.lit(0.0)).alias("avg_corr"))


def _gap_pairs(series: DataFrame, window: int, tile: int, chunk: int) -> DataFrame:
    """(symbol, d, total, n) over pairs and dates on which at least one of the two lacks a return in its window.

    A symbol with gaps in the chunk meets all others in tiles of bounded size; a
    partner without gaps gets its share from the same pair.
    """
    size = window + 1
    count = series.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / tile).alias("_all"), F.ceil(F.count_if("gappy") / tile).alias("_some")).where("_some > 0")
    rows = series.join(count, "chunk")

    def tiles(c: str):
        return F.pmod(F.xxhash64("symbol"), F.col(c)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    mine, every = tiles("_some")[0], tiles("_all")[1]
    left = rows.where("gappy").select("chunk", mine.alias("ta"), every.alias("tb"), F.lit(0).alias("side"), "symbol", "x", "here", "gappy")
    mine, every = tiles("_all")[0], tiles("_some")[1]
    right = rows.select("chunk", every.alias("ta"), mine.alias("tb"), F.lit(1).alias("side"), "symbol", "x", "here", "gappy")

    def rolled(v: np.ndarray) -> np.ndarray:
        s = np.concatenate([np.zeros(v.shape[:-1] + (1,)), np.cumsum(v, axis=-1)], axis=-1)
        return s[..., size:] - s[..., :-size]

    def pairs(key: dict, t: pa.Table) -> Iterator[dict]:
        side, names = t.column("side").to_numpy(), t.column("symbol").to_pylist()
        x = np.array([np.frombuffer(v) for v in t.column("x").to_pylist()])
        here = np.array([np.frombuffer(v, bool)[window:] for v in t.column("here").to_pylist()])
        gappy = t.column("gappy").to_numpy(zero_copy_only=False)
        seen = ~np.isnan(x)
        full = rolled(seen.astype(float)) == size
        b = np.flatnonzero(side == 1)
        totals, counts = np.zeros((len(x), chunk)), np.zeros((len(x), chunk), int)
        for k in np.flatnonzero(side == 0).tolist():
            both = seen[k] & seen[b]
            u, v = np.where(both, x[k], 0.0), np.where(both, x[b], 0.0)
            n, su, sv, suu, svv, suv = rolled(both.astype(float)), rolled(u), rolled(v), rolled(u * u), rolled(v * v), rolled(u * v)
            du, dv = n * suu - su * su, n * svv - sv * sv
            fine = (n > 1) & (du > 1e-12 * n * suu) & (dv > 1e-12 * n * svv) & ~(full[k] & full[b])
            fine &= np.array([names[i] != names[k] for i in b])[:, None]
            with np.errstate(invalid="ignore", divide="ignore"):
                corr = np.where(fine, (n * suv - su * sv) / np.sqrt(du * dv), 0.0)
            totals[k] += corr.sum(axis=0)
            counts[k] += fine.sum(axis=0)
            mirror = ~gappy[b]
            totals[b[mirror]] += corr[mirror]
            counts[b[mirror]] += fine[mirror]
        for i in np.flatnonzero(counts.any(axis=1)).tolist():
            days = np.flatnonzero((counts[i] > 0) & here[i])
            for d in days.tolist():
                yield {"symbol": names[i], "d": key["chunk"] * chunk + d, "total": totals[i, d], "n": int(counts[i, d])}

    met = left.unionByName(right)
    return each_run(met, ["chunk", "ta", "tb"], pairs, "symbol string, d bigint, total double, n bigint").select("symbol", "d", "total", "n")


def correlation_rotation(p: DataFrame, window: int = 60, part: int = 3) -> DataFrame:
    scores = average_correlation(p, window).select("symbol", "d", F.round("avg_corr", 9).alias("score"))
    return _equal(pick_top(scores, share=lambda n: F.floor(n / part), descending=False))


def overnight_drift(p: DataFrame, top_pct: float = 0.2, lookback: int = 504) -> DataFrame:
    """Long the best and short the worst overnight-minus-intraday means, half each."""
    scores = cut(_scored(p, feat.overnight_score(lookback)))
    n = lambda c: F.floor(c * top_pct)
    top = pick_top(scores, share=n).select("symbol", "d", (F.lit(0.5) / F.col("_held")).alias("weight"), F.lit(1).alias("signal"))
    low = pick_top(scores, share=n, descending=False).select(
        "symbol", "d", (F.lit(-0.5) / F.col("_held")).alias("weight"), F.lit(-1).alias("signal"))
    return top.join(low, ["symbol", "d"], "left_anti").unionByName(low)


def attention(p: DataFrame, top_pct: float = 0.2, window: int = 20) -> DataFrame:
    """Cross-sectional z of average volume plus z of return, best fifth."""
    df = feat.compute(p, {"_v": feat.sma(window, "volume"), "_r": feat.momentum(window)})
    df = cut(df.where(F.col("_v").isNotNull() | F.col("_r").isNotNull()).select("symbol", "d", "_v", "_r"))
    stats = df.groupBy("d").agg(
        F.avg("_v").alias("_mv"), F.stddev_samp("_v").alias("_sv"), F.avg("_r").alias("_mr"), F.stddev_samp("_r").alias("_sr"))
    df = df.join(stats.where(F.col("_mv").isNotNull() & F.col("_mr").isNotNull()), "d")
    z = (F.col("_v") - F.col("_mv")) / (F.col("_sv") + 1e-8) + (F.col("_r") - F.col("_mr")) / (F.col("_sr") + 1e-8)
    scores = df.select("symbol", "d", F.round(z, 9).alias("score"))
    return _equal(pick_top(scores, share=lambda n: F.floor(n * top_pct)))


def mean_reversion(p: DataFrame, lookback: int = 20, entry: float = -2.0) -> DataFrame:
    """Equal weight over symbols whose return z-score is below ``entry``.

    A z-score over n rows cannot pass (n - 1) / sqrt(n), so short windows with
    the usual entry never fire; the default window is 20.
    """
    return _equal_share(_scored(p, feat.return_z_score(lookback)).where(F.col("score") < entry))


def pairs(p: DataFrame, pair_list=tuple(dims.PAIRS), entry: float = 2.0, window: int = 60) -> DataFrame:
    """Half long, half short when a pair's spread z-score is extreme; the later pair wins a shared symbol."""
    spark: SparkSession = p.sparkSession
    dim = dims.frame(spark, [(i, a, b) for i, (a, b) in enumerate(pair_list)], "pair int, a string, b string")
    legs = p.select("symbol", "d", "close")
    a = legs.withColumnsRenamed({"symbol": "a", "close": "_ca"}).join(F.broadcast(dim), "a")
    b = legs.withColumnsRenamed({"symbol": "b", "close": "_cb"}).join(F.broadcast(dim.select("pair", "b")), "b")
    spread = cut(a.drop("b").join(b, ["pair", "d"]).select(
        "pair", "d", "a", "b", (F.col("_ca") - F.col("_cb")).alias("close")))
    first = spread.groupBy("pair").agg(F.min("d").alias("_d0"))
    spread = spread.join(first, "pair").withColumn("_i", F.col("d") - F.col("_d0"))
    z = feat.compute(spread, {"z": feat.z_score(window)}, keys=("pair",), order="d")
    side = F.when(F.col("z") > entry, -1).when(F.col("z") < -entry, 1)
    hot = z.withColumn("_s", side).where(F.col("_s").isNotNull())
    both = hot.select("pair", "d", F.explode(F.array(
        F.struct(F.col("a").alias("symbol"), F.col("_s").alias("signal")),
        F.struct(F.col("b").alias("symbol"), (-F.col("_s")).alias("signal")))).alias("_l"))
    return both.select("pair", "d", "_l.symbol", "_l.signal").groupBy("symbol", "d").agg(
        F.max_by("signal", "pair").alias("signal")).withColumn("weight", F.col("signal") * 0.5)


# name -> (panel to decision weights, normalise after the shift): the strategy catalogue
REGISTRY: dict[str, tuple[Callable[[DataFrame], DataFrame], bool]] = {
    "RSI_Rotation": (rsi_rotation, False),
    "Momentum_Rotation": (momentum_rotation, False),
    "Golden_Cross": (golden_cross, False),
    "XLU/SPY_Rotation": (lambda p: ratio_rotation(p, "XLU/SPY_Rotation", "XLU", "SPY"), True),
    "QQQ/SPY_Rotation": (lambda p: ratio_rotation(p, "QQQ/SPY_Rotation", "QQQ", "SPY"), True),
    "Credit_Rotation": (lambda p: ratio_rotation(p, "Credit_Rotation", "HYG", "IEF"), True),
    "VIX_Rotation": (vix_rotation, True),
    "Managed_Futures_Rotation": (managed_futures, True),
    "Volatility_Rotation": (volatility_rotation, False),
    "Correlation_Rotation": (correlation_rotation, False),
    "Overnight_Drift": (overnight_drift, False),
    "Attention_Stocks": (attention, False),
    "MeanReversion_Intraday": (mean_reversion, False),
    "Hedging_System": (hedging, False),
    "Pairs_Trading_StatArb": (pairs, False),
}


def normalise(weights: DataFrame, by=("d",), gross: bool = False) -> DataFrame:
    """Divide by the net (or gross) sum per date; a zero sum leaves the weights."""
    by = list(by)
    w = F.abs("weight") if gross else F.col("weight")
    total = weights.groupBy(*by).agg(F.sum(w).alias("_sum"))
    safe = F.when(F.col("_sum") == 0, 1.0).otherwise(F.col("_sum"))
    return weights.join(total, by).withColumn("weight", F.col("weight") / safe).drop("_sum")


def strategy_weights(p: DataFrame, name: str, cal: DataFrame | None = None) -> DataFrame:
    """weights(strategy, symbol, ts, d, weight, signal) in force on each date."""
    build, norm = REGISTRY[name]
    w = build(p)
    w = normalise(w) if norm else w
    cal = p.select("d", "ts").distinct() if cal is None else cal
    return next_bar(w, cal).select(F.lit(name).alias("strategy"), "symbol", "ts", "d", "weight", "signal")


def all_weights(p: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Weights of many strategies, each stored once."""
    cal = cut(p.select("d", "ts").distinct())
    out = None
    for name in sorted(names or REGISTRY):
        one = strategy_weights(p, name, cal)
        out = one if out is None else out.unionByName(one)
    return cut(out)


def meta_weights(spark: SparkSession, names: list[str]) -> DataFrame:
    """Equal ensemble weight for every enabled strategy."""
    return dims.frame(spark, [(n, 1.0 / len(names)) for n in names], "strategy string, meta_weight double")


def ensemble(weights: DataFrame, meta: DataFrame, gross: bool = False) -> DataFrame:
    """Weighted sum over strategies per (ts, symbol), normalised per date.

    ``meta(strategy, meta_weight)``; a strategy without a row is disabled.
    """
    w = weights.join(meta, "strategy")
    both = w.groupBy("symbol", "d", "ts").agg(
        F.sum(F.col("weight") * F.col("meta_weight")).alias("weight"),
        F.sum(F.col("signal") * F.col("meta_weight")).alias("signal"))
    return normalise(both, gross=gross)


def portfolio_returns(weights: DataFrame, returns: DataFrame, cal: DataFrame) -> DataFrame:
    """Sum of weight times asset return per date; dates without weights return 0."""
    day = weights.select("symbol", "d", "weight").join(returns.select("symbol", "d", "ret"), ["symbol", "d"])
    day = day.groupBy("d").agg(F.sum(F.col("weight") * F.coalesce(F.col("ret"), F.lit(0.0))).alias("ret"))
    return cal.join(day, "d", "left").withColumn("ret", F.coalesce(F.col("ret"), F.lit(0.0)))


def strategy_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Sparse returns per (strategy, d): only dates on which the strategy holds something."""
    day = weights.select("strategy", "symbol", "d", "weight").join(returns.select("symbol", "d", "ret"), ["symbol", "d"])
    return day.groupBy("strategy", "d").agg(
        F.sum(F.col("weight") * F.coalesce(F.col("ret"), F.lit(0.0))).alias("ret"))


def diversification(strat_rets: DataFrame, dates: DataFrame) -> DataFrame:
    """Average off-diagonal correlation of strategies and the diversification ratio.

    Returns are sparse with zeros elsewhere, so moments need only sums and the
    number of dates T; the sum of all correlations is the variance of the summed
    z-scores, so no pairs of strategies are formed.
    """
    t = dates.agg(F.count(F.lit(1)).cast("double").alias("_t"))
    m = strat_rets.groupBy("strategy").agg(F.sum("ret").alias("_s"), F.sum(F.col("ret") * F.col("ret")).alias("_q"))
    m = attach(m, t).withColumn("_mean", F.col("_s") / F.col("_t"))
    m = m.withColumn("_sd", F.sqrt(F.greatest(F.lit(0.0), (F.col("_q") - F.col("_t") * F.col("_mean") * F.col("_mean")) / (F.col("_t") - 1))))
    live = m.where(F.col("_sd") > 0)
    shift = live.agg(F.sum(F.col("_mean") / F.col("_sd")).alias("_off"), F.count(F.lit(1)).alias("_k"))
    z = strat_rets.join(live.select("strategy", "_sd"), "strategy").groupBy("d").agg(
        F.sum(F.col("ret") / F.col("_sd")).alias("_z"))
    # summed z-score of a date = _z - _off, and -_off on dates without positions
    tot = attach(attach(z, shift), t).agg(
        F.sum((F.col("_z") - F.col("_off")) * (F.col("_z") - F.col("_off"))).alias("_ss"), F.count(F.lit(1)).alias("_seen"))
    n = m.agg(F.count(F.lit(1)).alias("num_systems"))
    row = attach(attach(attach(tot, shift), t), n)
    every = F.col("_ss") + (F.col("_t") - F.col("_seen")) * F.col("_off") * F.col("_off")
    avg = F.try_divide(every / (F.col("_t") - 1) - F.col("_k"), F.col("_k") * (F.col("_k") - 1.0))
    k = F.col("num_systems")
    return row.select("num_systems", avg.alias("avg_correlation"),
                      F.when(avg < 1, F.sqrt(k) / F.sqrt(F.lit(1.0) + (k - 1) * avg)).otherwise(1.0).alias("diversification_ratio"))
