"""Drawdowns, performance statistics, exact percentiles and distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.scalars import TRADING_DAYS, change, norm_cdf, norm_ppf
from barloom.operators.timeline import scan, time_block
from barloom.session import cut

ANNUAL = math.sqrt(TRADING_DAYS)
EULER_GAMMA = 0.5772156649  # fixed value
SHARPE_VARIANCE = 0.15      # fixed value: variance of trial Sharpe ratios


def drawdown(df: DataFrame, keys=("series_id",), value: str = "equity", order: str = "ts") -> DataFrame:
    """Add ``drawdown``: value over its running maximum, minus one."""
    out = scan(df, {"_peak": ("max", F.col(value))}, keys, order)
    return out.withColumn("drawdown", change(F.col(value), F.col("_peak"))).drop("_peak")


def drawdown_duration(df: DataFrame, keys=("series_id",), value: str = "equity", order: str = "ts") -> DataFrame:
    """Add ``duration``: bars since the last new high."""
    df = cut(df).withColumn("_tb", time_block(order))
    out = scan(df, {"_peak": ("max", F.col(value)), "_rn": ("count", F.lit(1))}, keys, order)
    top = F.when(F.col(value) == F.col("_peak"), F.col("_rn"))
    out = scan(out, {"_top": ("last", top)}, keys, order)
    return out.withColumn("duration", F.col("_rn") - F.coalesce(F.col("_top"), F.lit(0))).drop(
        "_peak", "_rn", "_top", "_tb")


# ----------------------------------------------------------- metric expressions

def _zero_safe(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def sharpe(x: Column | str = "ret") -> Column:
    return _zero_safe(F.avg(x), F.stddev_samp(x)) * ANNUAL


def sortino(x: str = "ret") -> Column:
    down = F.when(F.col(x) < 0, F.col(x))
    risk = F.when(F.count(down) > 1, F.stddev_samp(down)).otherwise(F.stddev_samp(x))
    return _zero_safe(F.avg(x), risk) * ANNUAL


def annual_vol(x: str = "ret") -> Column:
    return F.stddev_samp(x) * ANNUAL


def win_rate(x: str = "ret") -> Column:
    return F.count_if(F.col(x) > 0) / F.count(x) * 100


def profit_factor(x: str = "ret") -> Column:
    c = F.col(x)
    return F.try_divide(F.sum(F.when(c > 0, c)), F.abs(F.sum(F.when(c < 0, c))))


def total_return(x: str = "ret") -> Column:
    return F.product(F.lit(1.0) + F.coalesce(F.col(x), F.lit(0.0))) - 1


def mean_return(x: str = "ret") -> Column:
    return F.avg(x)


# metric functions by name: an aggregate Column over a return column
METRICS = {"sharpe": sharpe, "sortino": sortino, "annual_vol": annual_vol, "win_rate": win_rate,
           "profit_factor": profit_factor, "total_return": total_return, "mean_return": mean_return}


def psr(sr: Column, n: Column, skew: Column, kurt: Column, benchmark: float = 0.0, min_obs: int = 10) -> Column:
    """Probabilistic Sharpe from moments; ``kurt`` is not excess.

    NULL below ``min_obs`` observations; an undefined denominator counts as 1.
    """
    inner = F.lit(1.0) - skew * sr + (kurt - 1) / 4.0 * sr * sr
    denom = F.when(inner > 0, F.sqrt(inner)).otherwise(1.0)
    z = (sr - F.lit(benchmark)) * F.sqrt(n - 1.0) / denom
    return F.when(n >= min_obs, norm_cdf(z))


def deflated_threshold(trials: int = 10) -> float:
    """Expected best Sharpe among ``trials`` unskilled strategies."""
    m = max(2, trials)
    return math.sqrt(SHARPE_VARIANCE) * (
        (1 - EULER_GAMMA) * norm_ppf(1 - 1 / m) + EULER_GAMMA * norm_ppf(1 - 1 / (m * math.e)))


def metrics(curve: DataFrame, keys=("series_id",), value: str = "equity", year_basis: str = "calendar",
            trials: int = 10) -> DataFrame:
    """Performance row per series of an equity (or price) curve.

    One scan gives return and running peak, one map-side combined aggregate the
    rest. ``year_basis`` is ``calendar`` (365.25 days) or ``bars`` (n / 252).
    ``psr_annualised`` mixes the annual Sharpe with the daily count, as commonly
    reported; ``psr`` is the published per-period form.
    """
    keys = list(keys)
    df = scan(curve, {"_prev": ("prev", F.col(value)), "_peak": ("max", F.col(value))}, keys)
    df = df.withColumns({"ret": change(F.col(value), F.col("_prev")), "_dd": change(F.col(value), F.col("_peak"))})
    g = df.groupBy(*keys).agg(
        F.min("ts").alias("_t0"), F.max("ts").alias("_t1"), F.min_by(value, "ts").alias("_v0"),
        F.max_by(value, "ts").alias("final_value"), F.count("ret").alias("n_returns"),
        F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_std"), F.min("_dd").alias("max_dd"),
        F.skewness("ret").alias("skewness"), (F.kurtosis("ret") + 3).alias("kurtosis"),
        sharpe("ret").alias("sharpe"), sortino("ret").alias("sortino"), win_rate("ret").alias("win_rate"),
        profit_factor("ret").alias("profit_factor"), annual_vol("ret").alias("annual_vol"))
    years = (F.datediff("_t1", "_t0") / 365.25) if year_basis == "calendar" else F.col("n_returns") / float(TRADING_DAYS)
    growth = F.try_divide("final_value", "_v0")
    g = g.withColumns({"total_return": growth - 1, "cagr": F.when(years > 0, F.pow(growth, 1 / years) - 1).otherwise(0.0)})
    n, sk, ku = F.col("n_returns"), F.col("skewness"), F.col("kurtosis")
    per_bar = _zero_safe(F.col("_mean"), F.col("_std"))
    return g.withColumns({
        "calmar": _zero_safe(F.col("cagr"), F.abs("max_dd")),
        "psr_annualised": psr(F.col("sharpe"), n, sk, ku),
        "dsr_annualised": psr(F.col("sharpe"), n, sk, ku, deflated_threshold(trials)),
        "psr": psr(per_bar, n, sk, ku),
    }).drop("_t0", "_t1", "_v0", "_mean", "_std")


def summary_metrics(curve: DataFrame, keys=("series_id",), value: str = "equity") -> DataFrame:
    """Short form: total return, CAGR, Sharpe, max drawdown, volatility, final equity."""
    return metrics(curve, keys, value).select(
        *keys, "total_return", "cagr", "sharpe", F.col("max_dd").alias("maxdd"),
        F.col("annual_vol").alias("vol"), F.col("final_value").alias("final_equity"))


def max_drawdown(rets: DataFrame, keys, ret: str = "ret", order: str = "ts", block: Column | None = None) -> DataFrame:
    """max_dd and total return per series of simple returns, path by path."""
    df = rets if block is None else rets.withColumn("_tb", block)
    df = scan(df, {"_eq": ("product", F.lit(1.0) + F.coalesce(F.col(ret), F.lit(0.0)))}, keys, order)
    df = scan(df, {"_pk": ("max", F.col("_eq"))}, keys, order)
    return df.groupBy(*keys).agg(F.min(change(F.col("_eq"), F.col("_pk"))).alias("max_dd"),
                                 (F.max_by("_eq", order) - 1).alias("total_return"))


# ----------------------------------------------------------------- percentiles

def _narrowed(live: DataFrame, state: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Each wanted rank of ``state`` within a part of its range that holds a few thousandths of the rows, or one value.

    A quantile sketch proposes a value near the rank and two borders around it;
    exact counts of the five parts they make say which one holds the rank. The
    sketch only decides how fast the range shrinks, never what is found.
    """
    rows = live.join(state, keys).where((F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b")))
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    sketch = rows.groupBy(*keys, "_t").agg(F.approx_percentile("_v", grid, F.lit(10 * steps)).alias("_g"))
    at = F.floor(F.col("_rank") / F.col("_n") * steps).cast("int")
    near = cut(state.join(sketch, [*keys, "_t"]).select(
        *state.columns, F.get("_g", F.greatest(at - 1, F.lit(0))).alias("_lo"), F.get("_g", at).alias("_mid"),
        F.get("_g", F.least(at + 2, F.lit(steps))).alias("_hi")))  # stored, so that its size is known and no group is shuffled to meet it
    v = F.col("_v")
    part = (F.when(v < F.col("_lo"), 0).when(v < F.col("_mid"), 1).when(v == F.col("_mid"), 2).when(v <= F.col("_hi"), 3).otherwise(4))
    rows = live.join(near, keys).where((v >= F.col("_a")) & (v <= F.col("_b")))
    counts = rows.groupBy(*keys, "_t", "_rank", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_t").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = counts.withColumn("_rank", F.col("_rank") - before).where("_rank >= 0 AND _rank < _n")
    return cut(found.select(*state.columns))


def exact_percentiles(df: DataFrame, keys, value: str, points: dict[str, float], limit: int = 50_000, steps: int = 1000) -> DataFrame:
    """Exact interpolated percentiles per group without sorting or collecting a group.

    The ranks that are asked for are narrowed down: as long as a rank's range holds
    more than ``limit`` rows, one pass of counts with map-side combination shrinks
    it to a few parts in ``steps``. A group of 10^8 values needs two such passes,
    spread over all tasks like any aggregate; only the last ``limit`` rows of each
    rank are put in order.
    """
    keys = list(keys)
    live = cut(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")))
    size = live.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    place = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in points.items()}
    asked = F.array(*[F.struct(F.lit(f"{name}/{side}").alias("_t"), fn(pos).cast("bigint").alias("_rank"))
                      for name, pos in place.items() for side, fn in (("lo", F.floor), ("hi", F.ceil))])
    size = cut(size)
    state = cut(size.select(*keys, F.inline(asked), "_n", "_a", "_b"))
    many = (F.col("_n") > limit) & (F.col("_a") < F.col("_b"))
    while not state.where(many).isEmpty():
        state = cut(state.where(~many).unionByName(_narrowed(live, state.where(many), keys, steps)))
    open_ = state.where("_a < _b")
    rows = live.join(open_, keys).where((F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b")))
    ranked = rows.groupBy(*keys, "_t", "_rank", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_t").orderBy("_v"))
    ranked = ranked.withColumn("_upto", upto).where("_rank < _upto AND _rank >= _upto - _c").select(*keys, "_t", "_v")
    found = ranked.unionByName(state.where("_a = _b").select(*keys, "_t", F.col("_a").alias("_v")))
    pick = {t: F.max(F.when(F.col("_t") == t, F.col("_v"))) for name in points for t in (f"{name}/lo", f"{name}/hi")}
    out = found.join(size.select(*keys, "_n"), keys).groupBy(*keys, "_n").agg(*[v.alias(t) for t, v in pick.items()])
    return out.select(*keys, *[(F.col(f"`{n}/lo`") + (F.col(f"`{n}/hi`") - F.col(f"`{n}/lo`")) * (place[n] - F.floor(place[n]))).alias(n) for n in points])


def tail_metrics(rets: DataFrame, keys=("series_id",), ret: str = "ret") -> DataFrame:
    """VaR and CVaR (95, 99), tail ratio, bias-corrected skew and excess kurtosis."""
    keys = list(keys)
    rets = cut(rets.select(*keys, ret))
    q = exact_percentiles(rets, keys, ret, {"_q05": 0.05, "_q01": 0.01, "_q95": 0.95})
    x = F.col(ret)
    n, g1, g2 = F.col("_n"), F.col("_g1"), F.col("_g2")
    g = rets.join(q, keys).groupBy(*keys).agg(
        F.max("_q05").alias("_q05"), F.max("_q01").alias("_q01"), F.max("_q95").alias("_q95"),
        F.avg(F.when(x <= F.col("_q05"), x)).alias("_c05"), F.avg(F.when(x <= F.col("_q01"), x)).alias("_c01"),
        F.count(x).alias("_n"), F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"))
    return g.select(
        *keys, (-F.col("_q05")).alias("var_95"), (-F.col("_q01")).alias("var_99"),
        (-F.col("_c05")).alias("cvar_95"), (-F.col("_c01")).alias("cvar_99"),
        F.try_divide(F.col("_q95"), F.abs("_q05")).alias("tail_ratio"),
        F.try_divide(g1 * F.sqrt(n * (n - 1.0)), n - 2.0).alias("skew"),
        (F.try_divide(n - 1.0, (n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0)).alias("kurtosis"))


def ulcer_index(curve: DataFrame, keys=("series_id",), value: str = "equity") -> DataFrame:
    pct = F.col("drawdown") * 100
    return drawdown(curve, keys, value).groupBy(*keys).agg(F.sqrt(F.avg(pct * pct)).alias("ulcer_index"))


# --------------------------------------------------------------- distributions

def periodic_returns(rets: DataFrame, unit: str = "month", keys=("series_id",), ret: str = "ret") -> DataFrame:
    """Compounded return per calendar unit."""
    return rets.groupBy(*keys, F.date_trunc(unit, "ts").cast("date").alias("period")).agg(
        total_return(ret).alias("ret"))


def month_year_table(rets: DataFrame, years: list[int], keys=("series_id",), ret: str = "ret") -> DataFrame:
    """Month rows, one column per year; the year list is a parameter, so no extra pass."""
    monthly = periodic_returns(rets, "month", keys, ret)
    cols = [F.max(F.when(F.year("period") == y, F.col("ret"))).alias(f"y{y}") for y in years]
    return monthly.groupBy(*keys, F.month("period").alias("month")).agg(*cols)


def histogram(rets: DataFrame, bins: int = 50, keys=("series_id",), ret: str = "ret") -> DataFrame:
    """Equal-width histogram per series with edges and counts."""
    keys = list(keys)
    x = F.col(ret)
    rng = rets.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    slot = F.least(F.lit(bins - 1), F.floor(F.try_divide(x - lo, hi - lo) * bins))
    df = rets.where(x.isNotNull()).join(rng, keys).withColumn("bin", F.coalesce(slot, F.lit(0)).cast("int"))
    return df.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(lo + F.col("bin") * (hi - lo) / bins).alias("left_edge"))
