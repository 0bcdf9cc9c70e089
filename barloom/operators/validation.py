"""Walk-forward, resampling, sweeps and overfitting checks."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from barloom.functions.scalars import clip, gaussian, ratio, uniform
from barloom.operators import performance as perf
from barloom.operators.joins import join_windows
from barloom.operators.packed import (SHARPE, SIZE, Additive, each_block, each_run, ema_carry, ema_run, gaussians, pack, sum_fields, sums,
                                      total, uniforms)
from barloom.operators.timeline import blocks, ema_blocks, emas, expand, own, pick, window
from barloom.session import cut


# ------------------------------------------------------------------ walk-forward

def walk_forward_windows(spark: SparkSession, start: str, end: str, train: int = 756, gap: int = 1, test: int = 252,
                         step: int = 63) -> DataFrame:
    """Train/test windows in calendar days; every window fits inside [start, end]."""
    starts = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step} days"))
    df = spark.range(1).select(F.posexplode(starts).alias("window_id", "train_start"))
    df = df.withColumn("train_end", F.date_add("train_start", train))
    df = df.withColumn("test_start", F.date_add("train_end", gap))
    df = df.withColumn("test_end", F.date_add("test_start", test))
    return df.where(F.col("test_end") <= F.lit(end).cast("date"))


def holdout(rets: DataFrame, share: float = 0.7, metric: Callable[[str], Column] = perf.sharpe, keys=("symbol",)) -> DataFrame:
    """(keys, in_sample, out_of_sample): the metric on the first ``share`` of the rows of rets(keys, _i, ret) and on the rest."""
    keys = list(keys)
    size = rets.groupBy(*keys).agg((F.max("_i") + 1).alias("_n"))
    early = F.col("_i") < F.floor(F.col("_n") * share)
    df = rets.join(size, keys).withColumns({"_a": F.when(early, F.col("ret")), "_b": F.when(~early, F.col("ret"))})
    return df.groupBy(*keys).agg(metric("_a").alias("in_sample"), metric("_b").alias("out_of_sample"))


def _slot(ts: Column, bounds: list) -> Column:
    """How many of the sorted dates are at or before ``ts``, as a balanced tree of comparisons."""
    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(ts < F.lit(bounds[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))
    return between(0, len(bounds))


def walk_forward(rets: DataFrame, windows: DataFrame, metric: Additive = SHARPE, keys=("symbol",)) -> DataFrame:
    """Best parameter per window by its train metric, with its test metric and the mean test metric of all windows.

    ``rets(keys, param, ts, ret)``: returns of every parameter set in one frame.
    The borders of all windows cut time into slots. Every return is read once,
    into the metric's sums of its slot; the sums of a window are differences of
    running sums over the slots, of which there are at most four per window.
    """
    keys = list(keys)
    spans = [tuple(r) for r in windows.select("window_id", "train_start", "train_end", "test_start", "test_end").orderBy("window_id").collect()]
    day = datetime.timedelta(days=1)
    bounds = sorted({d for _, a, b, c, e in spans for d in (a, b + day, c, e + day)})
    at = {d: k + 1 for k, d in enumerate(bounds)}  # slots before a border are 0 .. at - 1
    names = ["n", *metric.names]

    live = rets.where(F.col("ret").isNotNull()).withColumn("_slot", _slot(F.col("ts").cast("date"), bounds))
    slots = live.groupBy(*keys, "param", "_slot").agg(F.count("ret").cast("double").alias("n"), *[
        F.sum(x).alias(k) for k, x in metric.exprs(F.col("ret")).items()])
    sums_of = F.map_from_entries(F.collect_list(F.struct("_slot", F.struct(*names))))
    by = slots.groupBy(*keys, "param").agg(sums_of.alias("_m"))
    run = F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds))), F.array(F.struct(*[F.lit(0.0).alias(k) for k in names])), lambda acc, k: F.array_append(
        acc, F.struct(*[(F.element_at(acc, -1)[x] + F.coalesce(F.col("_m")[k][x], F.lit(0.0))).alias(x) for x in names])))
    each = F.array(*[F.struct(F.lit(w).alias("window_id"), *[F.lit(at[d]).alias(f"_{x}") for x, d in zip("abcd", (a, b + day, c, e + day), strict=True)])
                     for w, a, b, c, e in spans])
    df = by.select(*keys, "param", run.alias("_run")).select("*", F.inline(each))

    def value(lo: str, hi: str) -> Column:
        return metric.finish(lambda k: F.get("_run", F.col(hi))[k] - F.get("_run", F.col(lo))[k])

    m = df.select(*keys, "window_id", "param", value("_a", "_b").alias("train_metric"), value("_c", "_d").alias("test_metric"),
                  (F.get("_run", F.col("_d"))["n"] - F.get("_run", F.col("_a"))["n"]).alias("_n")).where("_n > 0")
    best = m.groupBy(*keys, "window_id").agg(
        F.max_by(F.struct("param", "train_metric", "test_metric"), F.struct(F.round("train_metric", 9), -F.col("param"))).alias("_b"))
    return best.select(*keys, "window_id", "_b.param", "_b.train_metric", "_b.test_metric",
                       F.avg("_b.test_metric").over(Window.partitionBy(*keys)).alias("average_test"))


# ------------------------------------------------------------------------ sweeps

def grid(**values: list) -> list[dict]:
    """All combinations of the parameter lists, in order."""
    out: list[dict] = [{}]
    for name, options in values.items():
        out = [{**row, name: v} for row in out for v in options]
    return out


def ema_cross_sweep(bars: DataFrame, params: list[dict]) -> DataFrame:
    """Next-bar returns of an EMA-order position for every (fast, slow) pair.

    All distinct spans are columns of one block scan; the pairs become rows only
    afterwards. Result: (symbol, ts, param, fast, slow, ret).
    """
    spans = sorted({p["fast"] for p in params} | {p["slow"] for p in params})
    df = emas(ema_blocks(pick(bars, "close")), {f"_e{s}": (F.col("close"), s) for s in spans})
    w = window()
    df = df.withColumns({f"_p{s}": F.lag(f"_e{s}").over(w) for s in spans})
    rows = F.array(*[
        F.struct(F.lit(i).alias("param"), F.lit(p["fast"]).alias("fast"), F.lit(p["slow"]).alias("slow"),
                 (F.round(F.col(f"_p{p['fast']}") - F.col(f"_p{p['slow']}"), 9) > 0).cast("double").alias("pos"))
        for i, p in enumerate(params)])
    df = own(df.withColumns({"_ret": ratio(F.col("close"), F.col("_pc")) - 1, "_rows": rows}))
    df = df.where(F.col("_ret").isNotNull()).select("symbol", "ts", "_ret", F.inline("_rows"))
    return df.withColumn("ret", F.col("_ret") * F.coalesce(F.col("pos"), F.lit(0.0))).drop("_ret", "pos")


def sweep(bars: DataFrame, params: list[dict], position: Callable[[WindowSpec, dict], Column], lookback: int) -> DataFrame:
    """Next-bar returns of a strategy of the user's own for every parameter set: (symbol, ts, param, names of the set, ret).

    ``position(w, params)`` gives the position at the end of a bar as a Column over the window
    of a block with ``lookback`` earlier rows; NULL is flat. All sets are columns of one pass.
    """
    df = blocks(pick(bars, "close"), lookback + 1)
    w = window()
    df = df.withColumns({f"_q{i}": position(w, p) for i, p in enumerate(params)})
    df = df.withColumns({f"_p{i}": F.lag(f"_q{i}").over(w) for i in range(len(params))})
    rows = F.array(*[F.struct(F.lit(i).alias("param"), *[F.lit(v).alias(k) for k, v in p.items()], F.col(f"_p{i}").cast("double").alias("pos"))
                     for i, p in enumerate(params)])
    df = own(df.withColumns({"_ret": ratio(F.col("close"), F.col("_pc")) - 1, "_rows": rows}))
    df = df.where(F.col("_ret").isNotNull()).select("symbol", "ts", "_ret", F.inline("_rows"))
    return df.withColumn("ret", F.col("_ret") * F.coalesce(F.col("pos"), F.lit(0.0))).drop("_ret", "pos")


def sweep_scores(rets: DataFrame, metric: Callable[[str], Column] = perf.sharpe, keys=("symbol",)) -> DataFrame:
    """Metric of every parameter set with its place, best first."""
    keys = list(keys)
    names = [c for c in rets.columns if c not in (*keys, "ts", "ret", "_i")]
    m = rets.groupBy(*keys, *names).agg(metric("ret").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "param")
    return m.withColumn("place", F.row_number().over(order))


def parameter_sensitivity(scores: DataFrame, base: dict, keys=("symbol",)) -> DataFrame:
    """min(1, std / |mean|) over sets that differ from ``base`` in one parameter or none."""
    same = F.lit(0)
    for name, v in base.items():
        same = same + (F.col(name) == v).cast("int")
    near = scores.where(same >= len(base) - 1)
    # one grid value per varied parameter: the base itself occurs once per parameter
    weight = F.when(same == len(base), len(base)).otherwise(1)
    one = near.withColumn("_k", F.explode(F.sequence(F.lit(1), weight)))
    cv = F.stddev_pop("score") / (F.abs(F.avg("score")) + 1e-8)
    return one.groupBy(*keys).agg(F.least(F.lit(1.0), cv).alias("sensitivity"))


def neighbour_stability(scores: DataFrame, base: dict, values: dict[str, list], keys=("symbol",)) -> DataFrame:
    """1 - instability of the sets one grid step away from ``base`` in one parameter."""
    keys = list(keys)
    is_base, near = F.lit(True), F.lit(False)
    for name, v in base.items():
        is_base = is_base & (F.col(name) == v)
        at = values[name].index(v)
        steps = [values[name][k] for k in (at - 1, at + 1) if 0 <= k < len(values[name])]
        others = F.lit(True)
        for o, ov in base.items():
            if o != name:
                others = others & (F.col(o) == ov)
        near = near | (F.col(name).isin(*steps) & others)
    g = scores.groupBy(*keys).agg(
        F.max(F.when(is_base, F.col("score"))).alias("_base"), F.avg(F.when(near, F.col("score"))).alias("_mean"),
        F.stddev_pop(F.when(near, F.col("score"))).alias("_std"), F.count(F.when(near, 1)).alias("_n"))
    scale = F.abs("_base") + 1e-8
    unstable = (F.col("_std") / scale + F.abs(F.col("_base") - F.col("_mean")) / scale) / 2
    value = clip(F.lit(1.0) - F.least(F.lit(1.0), unstable), 0, 1)
    return g.select(*keys, F.when(F.col("_n") == 0, 1.0).otherwise(value).alias("stability"))


# -------------------------------------------------------------------- resampling

LEVELS = [0, 1, 2, 5, 10]  # basis points of the cost and slippage tests


def _score(original: Column, mean: Column, std: Column, c: float) -> Column:
    raw = F.lit(10.0) * (F.lit(1.0) - F.abs(original - mean) / (F.abs(original) + 1)) / (F.lit(1.0) + std * c)
    return clip(raw, 0, 10)


def robustness(sims: DataFrame, original: DataFrame, test: str, keys=("symbol",), c: float = 1.0) -> DataFrame:
    """Summary of simulated metrics(keys, sim, metric) against original(keys, original)."""
    keys = list(keys)
    g = sims.groupBy(*keys).agg(F.avg("metric").alias("mean_stressed"), F.stddev_pop("metric").alias("std_stressed"),
                                F.min("metric").alias("worst_case"), F.count("metric").alias("n_sim"))
    df = original.join(g, keys)
    return df.select(*keys, F.lit(test).alias("test"), "original", "mean_stressed", "std_stressed", "worst_case", "n_sim",
                     _score(F.col("original"), F.col("mean_stressed"), F.col("std_stressed"), c).alias("robustness_score"))


def original_metric(rets: DataFrame, metric: Callable[[str], Column], keys=("symbol",)) -> DataFrame:
    return rets.groupBy(*keys).agg(metric("ret").alias("original"))


def _simulated(rets: DataFrame, n: int) -> DataFrame:
    return rets.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _blocks(rets: DataFrame, columns: list[str], keys: list[str], size: int) -> DataFrame:
    """Packed returns with ``n``, the length of the series; simulations are arrays inside a block, never copies of rows."""
    blocks = cut(pack(rets, columns, keys, size))
    return blocks.join(blocks.groupBy(*keys).agg(F.sum("m").alias("n")), keys)


def _rows(row: dict) -> np.ndarray:
    return int(row["first"]) + np.arange(int(row["m"]))


def _summed(blocks: DataFrame, simulate: Callable[[dict], np.ndarray], metric: Additive, keys: list[str]) -> DataFrame:
    """Metric per simulation when ``simulate(block)`` gives the block's returns in all simulations, one row each."""
    def kernel(row: dict) -> Iterator[dict]:
        yield {k: v.tolist() for k, v in sums(metric, simulate(row)).items()}
    return total(each_block(blocks, kernel, sum_fields(metric), tuple(keys)), metric, keys)


def monte_carlo_drawdown(rets: DataFrame, n: int = 100, seed: int = 42, keys=("symbol",), segment: int = 1 << 16,
                         size: int = SIZE) -> DataFrame:
    """Max drawdown of each series under ``n`` random orders of its returns.

    ``rets(keys, _i, ret)``. A shuffle leaves mean and std unchanged, so the path
    metric is the one that moves. Blocks deal their returns by random key into
    segments of about ``segment`` returns of one simulated path; a segment is
    sorted by itself and leaves four numbers (product, highest and lowest point,
    deepest drawdown), from which the path's drawdown is folded.
    """
    keys = list(keys)
    sims = np.arange(n)

    def deal(row: dict) -> Iterator[dict]:
        i, r = _rows(row), row["ret"]
        u = uniforms(seed, sims, i)
        parts = -(-int(row["n"]) // segment)
        bucket = np.floor(u * parts).astype(np.int64)
        for sim in range(n):
            for k in range(parts):
                at = np.flatnonzero(bucket[sim] == k)
                if len(at):
                    yield {"sim": sim, "part": k, "data": np.stack([u[sim, at], i[at].astype(float), r[at]]).astype("<f8").tobytes()}

    def walk(key: dict, rows: pa.Table) -> Iterator[dict]:
        u, i, r = np.concatenate([np.frombuffer(d, "<f8").reshape(3, -1) for d in rows.column("data").to_pylist()], axis=1)
        path = np.cumprod(1.0 + r[np.lexsort((i, u))])
        yield {"p": path[-1], "high": path.max(), "low": path.min(), "dd": (path / np.maximum.accumulate(path)).min()}

    dealt = each_block(_blocks(rets, ["ret"], keys, size), deal, "sim int, part int, data binary", tuple(keys))
    parts = each_run(dealt, [*keys, "sim", "part"], walk, "p double, high double, low double, dd double")
    one = F.struct("part", "p", "high", "low", "dd")
    start = F.struct(F.lit(1.0).alias("p"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("dd"))
    fold = F.aggregate(F.sort_array(F.collect_list(one)), start, lambda a, x: F.struct(
        (a.p * x.p).alias("p"), F.greatest(a.high, a.p * x.high).alias("high"),
        F.least(a.dd, x.dd, a.p * x.low / a.high).alias("dd")))
    return parts.groupBy(*keys, "sim").agg(fold.alias("_f")).select(*keys, "sim", (F.col("_f.dd") - 1).alias("metric"))


def bootstrap(rets: DataFrame, metric: Additive = SHARPE, n: int = 100, seed: int = 43, keys=("symbol",),
              columns: tuple[str, ...] = ("ret",), size: int = SIZE) -> DataFrame:
    """Metric of ``n`` resamples with replacement, of every column on the same draws: (keys, sim, one metric per column).

    Every block draws for its own places and counts how often each row of each
    other block is hit; the counts meet the returns block by block and weigh
    them. A single column's metric is called ``metric``.
    """
    keys = list(keys)
    blocks = cut(_blocks(rets, list(columns), keys, size))

    def draw(row: dict) -> Iterator[dict]:
        at = np.floor(uniforms(seed, np.arange(n), _rows(row)) * row["n"]).astype(np.int64)
        hit, times = np.unique(at + (np.arange(n) * int(row["n"]))[:, None], return_counts=True)
        sim, at = np.divmod(hit, int(row["n"]))
        for b in np.unique(at // size):
            own = at // size == b
            yield {"b": int(b), "data": np.stack([sim[own], at[own] % size, times[own]]).astype("<i4").tobytes()}

    def weigh(row: dict) -> Iterator[dict]:
        sim, at, times = np.frombuffer(row["data"], "<i4").reshape(3, -1)
        out = {"n": np.bincount(sim, times, n).tolist()}
        for c in columns:
            for k, v in metric.parts(row[c]).items():
                out[f"{c}_{k}"] = np.bincount(sim, times * v[at], n).tolist()
        yield out

    drawn = each_block(blocks.select(*keys, "first", "m", "n"), draw, "b bigint, data binary", tuple(keys))
    names = [f"{c}_{k}" for c in columns for k in metric.names]
    parts = each_block(drawn.join(blocks.select(*keys, "b", *columns), [*keys, "b"]), weigh,
                       ", ".join(f"{k} array<double>" for k in ("n", *names)), tuple(keys))
    out = None
    for c in columns:
        mine = parts.select(*keys, "n", *[F.col(f"{c}_{k}").alias(k) for k in metric.names])
        one = total(mine, metric, keys, "metric" if len(columns) == 1 else c)
        out = one if out is None else out.join(one, [*keys, "sim"])
    return out


def noise_injection(rets: DataFrame, metric: Additive = SHARPE, level: float = 0.1, n: int = 100, seed: int = 44,
                    keys=("symbol",), size: int = SIZE) -> DataFrame:
    """Metric after adding Gaussian noise of ``level`` times the series' own std."""
    keys = list(keys)
    std = rets.groupBy(*keys).agg((F.stddev_samp("ret") * level).alias("sd"))
    return _summed(_blocks(rets, ["ret"], keys, size).join(std, keys),
                   lambda row: row["ret"] + gaussians(seed, np.arange(n), _rows(row)) * (row["sd"] or 0.0), metric, keys)


def missing_data(rets: DataFrame, metric: Additive = SHARPE, share: float = 0.05, n: int = 100, seed: int = 45,
                 keys=("symbol",), size: int = SIZE) -> DataFrame:
    """Metric after replacing a random share of returns by 0."""
    keys = list(keys)
    return _summed(_blocks(rets, ["ret"], keys, size),
                   lambda row: np.where(uniforms(seed, np.arange(n), _rows(row)) < share, 0.0, row["ret"]), metric, keys)


def start_dates(rets: DataFrame, metric: Additive = SHARPE, n: int = 100, low: float = 0.0, high: float = 0.3,
                min_rows: int = 30, keys=("symbol",), size: int = SIZE) -> DataFrame:
    """Metric from ``n`` evenly spaced start rows in the first part of the history: running sums from the end of each block."""
    keys = list(keys)

    def kernel(row: dict) -> Iterator[dict]:
        size, m = int(row["n"]), int(row["m"])
        a, b = np.floor(size * low), np.floor(size * high)
        start = np.floor(a + (b - a) * (np.arange(n) / float(max(1, n - 1))))
        first = np.clip(start - int(row["first"]), 0, m).astype(np.int64)
        live = size - start >= min_rows
        out = {"n": np.where(live, m - first, 0).astype(float).tolist()}
        for k, v in metric.parts(row["ret"]).items():
            tail = np.append(np.cumsum(v[::-1])[::-1], 0.0)
            out[k] = np.where(live, tail[first], 0.0).tolist()
        yield out

    return total(each_block(_blocks(rets, ["ret"], keys, size), kernel, sum_fields(metric), tuple(keys)), metric, keys)


def parameter_perturbation(bars: DataFrame, fast: float, slow: float, metric: Additive = SHARPE, share: float = 0.1, n: int = 100,
                           keys=("symbol",), size: int = SIZE) -> DataFrame:
    """Metric of the EMA-order position for ``n`` evenly spaced slow spans within +-``share`` of ``slow``; sim ``n`` is ``slow`` itself.

    ``bars(keys, _i, _pc, close)``. All spans are one vector recurrence over the
    packed series; a block needs the state vector before it and one look back.
    """
    keys = list(keys)
    spans = [fast, *(slow * (1 + x) for x in np.linspace(-share, share, n)), slow]
    alpha = 2.0 / (np.array(spans) + 1.0)
    packed = cut(pack(bars.select(*keys, "_i", "close", F.col("_pc").alias("before")), ["close", "before"], keys, size))
    blocks = ema_carry(packed, "close", spans, keys, size)

    def kernel(row: dict) -> Iterator[dict]:
        x, before, first = row["close"], row["before"], row["b"] == 0
        if first:  # the seed is the first value itself; the first bar has no return
            x, before = x[1:], before[1:]
            state = ema_run(x, alpha, np.full(len(alpha), row["close"][0]))[:-1]
        else:
            state = ema_run(x, alpha, row["carry"])[:-1]
        held = np.round(state[:, :1] - state[:, 1:], 9) > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            r = x / before - 1.0
        ok = np.isfinite(r)
        yield {k: v.tolist() for k, v in sums(metric, (r[ok, None] * held[ok]).T).items()}

    return total(each_block(blocks, kernel, sum_fields(metric), tuple(keys)), metric, keys)


def cost_curve(gross: DataFrame, bps: list[float], keys=("symbol",), commission: float = 0.0) -> DataFrame:
    """CAGR (252-bar years), Sharpe and mean turnover per cost level of (keys, ts, ret, turnover).

    The levels are costs, or slippage on top of a fixed ``commission`` in basis points.
    """
    df = gross.withColumn("bps", F.explode(F.array(*[F.lit(float(b)) for b in sorted(set(bps))])))
    df = df.withColumn("ret", F.col("ret") - F.col("turnover") * (F.col("bps") + commission) / 10000.0)
    n = F.count("ret")
    return df.groupBy(*keys, "bps").agg(
        (F.pow(F.product(F.lit(1.0) + F.col("ret")), F.lit(252.0) / n) - 1).alias("cagr"),
        perf.sharpe("ret").alias("sharpe"), F.avg("turnover").alias("turnover"))


def cost_sensitivity(curve: DataFrame, keys=("symbol",)) -> DataFrame:
    """Range over |mean| of each metric across the cost levels."""
    def sens(x: str) -> Column:
        m = F.avg(x)
        return F.when(m == 0, 0.0).otherwise((F.max(x) - F.min(x)) / (F.abs(m) + 1e-8)).alias(f"{x}_sensitivity")
    return curve.groupBy(*keys).agg(sens("cagr"), sens("sharpe"), sens("turnover"))


def cost_robustness(curve: DataFrame, test: str, base_bps: float = 2.0, metric: str = "sharpe", keys=("symbol",)) -> DataFrame:
    """Score by how far the worst cost or slippage level falls below the base level."""
    g = curve.groupBy(*keys).agg(F.max(F.when(F.col("bps") == base_bps, F.col(metric))).alias("original"),
                                 F.avg(metric).alias("mean_stressed"), F.min(metric).alias("worst_case"))
    o = F.col("original")
    return g.withColumn("test", F.lit(test)).withColumn("robustness_score", clip(F.lit(10.0) * (F.lit(1.0) - F.abs(o - F.col("worst_case")) / (F.abs(o) + 1)), 0, 10))


def overall_robustness(results: DataFrame, keys=("symbol",)) -> DataFrame:
    """Mean, median, spread, extremes, worst test, label and breakdown over the tests of each series."""
    s = "robustness_score"
    mean = F.avg(s)
    lines = F.sort_array(F.collect_list(F.concat("test", F.lit("="), F.format_string("%.2f", s))))  # one per test
    return results.groupBy(*keys).agg(
        F.round(mean, 2).alias("overall_score"), F.round(F.percentile(s, F.lit(0.5)), 2).alias("median_score"),
        F.round(F.min(s), 2).alias("min_score"), F.round(F.max(s), 2).alias("max_score"), F.round(F.stddev_pop(s), 2).alias("std_score"),
        F.min_by("test", s).alias("worst_test"), F.count(F.lit(1)).alias("num_tests"),
        F.when(mean >= 7, "Robust").when(mean >= 4, "Moderate").otherwise("Fragile").alias("interpretation"),
        F.array_join(lines, "; ").alias("breakdown"))


# ------------------------------------------------------------------- overfitting

def walk_forward_stability(results: DataFrame, keys=("symbol",)) -> DataFrame:
    """(correlation + 1) / 2 times the clipped test/train ratio over the windows."""
    g = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.corr("train_metric", "test_metric").alias("_c"),
                                   F.avg("train_metric").alias("_is"), F.avg("test_metric").alias("_oos"))
    corr = F.when(F.col("_n") < 2, 0.0).otherwise(F.coalesce(F.nanvl("_c", F.lit(0.0)), F.lit(0.0)))
    share = F.when(F.col("_is") == 0, 0.0).otherwise(F.col("_oos") / (F.col("_is") + 1e-8))
    return g.select(*keys, clip((corr + 1) / 2 * clip(share, 0, 1), 0, 1).alias("stability"))


def overfitting_probability(rets: DataFrame, splits: int = 16, min_rows: int = 10, keys=("symbol",)) -> DataFrame:
    """Share of splits whose best in-sample set is below the out-of-sample median.

    ``rets(keys, param, _i, ret)``. Split points are evenly spaced rows between
    the first and third quarter of the history.
    """
    keys = list(keys)
    size = rets.groupBy(*keys).agg((F.max("_i") + 1).alias("_n"))
    df = _simulated(rets.join(size, keys), splits).withColumnRenamed("sim", "split")
    at = F.floor(F.col("_n") / 4 + F.col("split") * F.col("_n") / (2.0 * splits))
    df = df.withColumns({"_is": F.when(F.col("_i") < at, F.col("ret")), "_oos": F.when(F.col("_i") >= at, F.col("ret"))})
    m = df.groupBy(*keys, "split", "param").agg(
        perf.sharpe("_is").alias("a"), perf.sharpe("_oos").alias("b"), F.count("_is").alias("na"), F.count("_oos").alias("nb"))
    m = cut(m.where((F.col("na") >= min_rows) & (F.col("nb") >= min_rows)).withColumns({"a": F.round("a", 9), "b": F.round("b", 9)}))
    best = m.groupBy(*keys, "split").agg(F.max_by("b", F.struct("a", -F.col("param"))).alias("_best"))
    rank = m.join(best, [*keys, "split"]).groupBy(*keys, "split").agg(
        F.count_if(F.col("b") <= F.col("_best")).alias("_rank"), F.count(F.lit(1)).alias("_k"))
    return rank.groupBy(*keys).agg((F.count_if(F.col("_rank") < F.floor(F.col("_k") / 2)) / F.count(F.lit(1))).alias("pbo"))


def reality_check(rets: DataFrame, n: int = 100, seed: int = 46, centred: bool = True, min_rows: int = 30, keys=("symbol",)) -> DataFrame:
    """Bootstrap p-value of the Sharpe excess over a benchmark on paired rows.

    ``rets(keys, _i, ret, bench_ret)``. Centred: resampled excess minus the
    observed one is compared with the observed one (the null hypothesis);
    otherwise the raw resampled excess is, which hovers around one half.
    """
    keys = list(keys)
    seen = rets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (perf.sharpe("ret") - perf.sharpe("bench_ret")).alias("_obs"))
    sims = bootstrap(rets, SHARPE, n, seed, keys, ("ret", "bench_ret"))
    x = F.col("ret") - F.col("bench_ret")
    x = x - F.col("_obs") if centred else x
    df = sims.join(seen, keys).groupBy(*keys).agg(F.avg((x >= F.col("_obs")).cast("double")).alias("_p"), F.max("_n").alias("_n"))
    return df.select(*keys, F.when(F.col("_n") < min_rows, 1.0).otherwise(F.col("_p")).alias("p_value"))


def model_confidence(scores: DataFrame, keys=("symbol",)) -> DataFrame:
    """Share of parameter sets whose score is within one population std of the best."""
    keys = list(keys)
    g = scores.groupBy(*keys).agg(F.max("score").alias("_best"), F.stddev_pop("score").alias("_sd"), F.count(F.lit(1)).alias("_k"))
    bar = F.when(F.when(F.col("_k") > 1, F.col("_sd")).otherwise(1.0) > 0,
                 F.col("_best") - F.when(F.col("_k") > 1, F.col("_sd")).otherwise(1.0)).otherwise(F.col("_best") * 0.9)
    return scores.join(g, keys).groupBy(*keys).agg((F.count_if(F.round("score", 9) >= F.round(bar, 9)) / F.count(F.lit(1))).alias("confidence_share"))


def overfitting_score(parts: DataFrame, threshold: float = 6.0) -> DataFrame:
    """Total 0-10 of (sensitivity, neighbour, walk_forward, pbo, dsr, p_value, confidence_share) with warnings."""
    c = F.col
    total = (c("sensitivity") * 2 + (1 - c("neighbour")) * 2 + (1 - c("walk_forward")) * 2 + c("pbo") * 2
             + (1 - c("dsr")) * 2 + c("p_value") + c("confidence_share"))
    df = parts.withColumn("overall", clip(total, 0, 10))
    flags = [(c("sensitivity") > 0.5, "parameter sensitivity"), (c("neighbour") < 0.5, "neighbour stability"),
             (c("walk_forward") < 0.5, "walk-forward stability"), (c("pbo") > 0.5, "backtest overfitting probability"),
             (c("dsr") < 0.8, "deflated Sharpe"), (c("p_value") > 0.5, "reality check"),
             (c("confidence_share") > 0.7, "model confidence"), (c("overall") >= threshold, "overfitting detected")]
    return df.withColumns({"is_overfitted": c("overall") >= threshold,
                           "warnings": F.array_compact(F.array(*[F.when(k, F.lit(t)) for k, t in flags]))})


# ------------------------------------------------------------------------ stress

def historical_stress(curve: DataFrame, scenarios: DataFrame, keys=("series_id",), value: str = "equity") -> DataFrame:
    """Return and max drawdown inside each scenario(name, start, end); empty ones are kept."""
    keys = list(keys)
    inside = cut(join_windows(curve, scenarios))
    dd = perf.drawdown(inside, [*keys, "name"], value).groupBy(*keys, "name").agg(
        (F.max_by(value, "ts") / F.min_by(value, "ts") - 1).alias("total_return"), F.min("drawdown").alias("max_dd"))
    every = expand(curve.select(*keys).distinct(), scenarios.select("name"))
    return every.join(dd, [*keys, "name"], "left")


def synthetic_stress(rets: DataFrame, shocks: list[tuple[str, float]], keys=("symbol",), tail: int = 60) -> DataFrame:
    """Stressed total return, drawdown and volatility for (kind, factor) shocks.

    ``rets(keys, ts, _i, ret)``. Kinds: volatility scales returns, rate lowers
    the last ``tail`` rows, correlation scales by half the excess factor.
    """
    keys = list(keys)
    if bad := {k for k, _ in shocks} - {"volatility", "rate", "correlation"}:
        raise ValueError(f"unknown shock kinds {bad}")
    size = rets.groupBy(*keys).agg((F.max("_i") + 1).alias("_n"))
    kinds = F.array(*[F.struct(F.lit(k).alias("shock"), F.lit(float(f)).alias("factor")) for k, f in shocks])
    df = rets.join(size, keys).select("*", F.inline(kinds))
    r, f = F.col("ret"), F.col("factor")
    hit = (F.when(F.col("shock") == "volatility", r * f)
           .when(F.col("shock") == "rate", F.when(F.col("_i") >= F.col("_n") - tail, r - F.lit(0.01) * f / 252).otherwise(r))
           .otherwise(r * (F.lit(1.0) + (f - 1) * 0.5)))
    df = cut(df.withColumn("stressed", hit).select(*keys, "ts", "shock", "factor", "ret", "stressed"))
    by = [*keys, "shock", "factor"]
    vol = df.groupBy(*by).agg(perf.annual_vol("stressed").alias("volatility"), perf.annual_vol("ret").alias("original_volatility"))
    return perf.max_drawdown(df, by, "stressed").join(vol, by)


# fixed values: least value and points of a Sharpe ratio, the walk-forward result (above it) and the stress result (above it)
SHARPE_POINTS, NO_SHARPE_POINTS = ((1.2, 2.0), (0.8, 1.5), (0.5, 1.0), (0.2, 0.5)), 0.2
WALK_POINTS, NO_WALK_POINTS = ((1.0, 2.0), (0.5, 1.5)), 0.7
STRESS_POINTS, NO_STRESS_POINTS = ((0.8, 1.5),), 1.0
# fixed values: points that can be had and coverage in percent, without and with a cross-asset part
AVAILABLE, COVERAGE = (8.5, 10.0), (85.0, 100.0)


def _points(steps: tuple, last: float, reached: Callable[[float], Column]) -> Column:
    return F.coalesce(*[F.when(reached(at), worth) for at, worth in steps], F.lit(last))


def validation_score(m: DataFrame) -> DataFrame:
    """Point table of (is_sharpe, oos_sharpe, walk_forward, stress, temporal, cross_asset, sensitivity)."""
    c = F.col
    cross = F.coalesce(c("cross_asset"), F.lit(0.0))
    raw = (_points(SHARPE_POINTS, NO_SHARPE_POINTS, lambda at: c("is_sharpe") >= at) + _points(SHARPE_POINTS, NO_SHARPE_POINTS, lambda at: c("oos_sharpe") >= at)
           + _points(WALK_POINTS, NO_WALK_POINTS, lambda at: c("walk_forward") > at) + _points(STRESS_POINTS, NO_STRESS_POINTS, lambda at: c("stress") > at)
           + c("temporal") + cross + c("sensitivity"))
    available, coverage = (F.when(cross == 0, without).otherwise(whole) for without, whole in (AVAILABLE, COVERAGE))
    return m.withColumns({"score_raw": raw, "score_available": available, "score_normalised": F.round(raw / available * 10, 2), "coverage_pct": coverage})
