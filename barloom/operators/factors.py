"""Factor returns from proxies and portfolio factor exposures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.operators import features as feat
from barloom.operators.joins import first_available
from barloom.operators.timeline import expand, index_bars, scan
from barloom.plans import dims
from barloom.session import cut


def chosen_proxies(bars: DataFrame) -> DataFrame:
    """First proxy per factor whose symbols have bars."""
    spark = bars.sparkSession
    candidates = dims.frame(spark, dims.FACTOR_PROXIES, "factor string, prio int, long string, short string")
    return first_available(candidates, bars.select("symbol").distinct(), "factor", ["long", "short"])


def factor_returns(bars: DataFrame) -> DataFrame:
    """factor(ts, factor, ret): long minus short return of the chosen proxy.

    A two-symbol factor aligns the closes of both symbols first and takes the
    returns of the aligned series; the first return and factors without any
    proxy are 0.
    """
    bars = cut(bars.select("symbol", "ts", "close"))
    prox = cut(chosen_proxies(bars))
    long = bars.join(F.broadcast(prox.select("factor", F.col("long").alias("symbol"), "short")), "symbol").select(
        "factor", "short", "ts", F.col("close").alias("_long"))
    short = bars.join(F.broadcast(prox.where(F.col("short") != "").select("factor", F.col("short").alias("symbol"))), "symbol").select(
        "factor", "ts", F.col("close").alias("_short"))
    both = long.join(short, ["factor", "ts"], "left").where((F.col("short") == "") | F.col("_short").isNotNull())
    both = cut(both.select("factor", "ts", "_long", "_short"))
    df = scan(both, {"_pl": ("prev", F.col("_long")), "_ps": ("prev", F.col("_short"))}, ["factor"])
    leg = F.try_divide("_long", "_pl") - F.coalesce(F.try_divide("_short", "_ps"), F.lit(1.0))
    found = df.select("ts", "factor", F.coalesce(leg, F.lit(0.0)).alias("ret"))
    every = dims.frame(bars.sparkSession, [(f,) for f in dims.FACTORS], "factor string")
    missing = every.join(prox, "factor", "left_anti")
    first = bars.agg(F.min("symbol").alias("symbol"))
    dates = bars.join(F.broadcast(first), "symbol", "left_semi").select("ts")
    zero = expand(dates, missing).select("ts", "factor", F.lit(0.0).alias("ret"))
    return found.unionByName(zero)


def default_scores(spark) -> DataFrame:
    return dims.frame(spark, dims.factor_score_rows(), "symbol string, factor string, score double")


def holdings_exposure(weights: DataFrame, scores: DataFrame, by=("ts",), digits: int = 4) -> DataFrame:
    """Exposure per date and factor: sum of w * score over sum of w.

    Symbols without scores count as 0, except leveraged ones, which get the
    fallback scores. A date whose weights sum to 0 has no exposure.
    """
    by = list(by)
    spark = weights.sparkSession
    w = cut(weights.select(*by, F.upper("symbol").alias("symbol"), "weight"))
    total = w.groupBy(*by).agg(F.sum("weight").alias("_sum")).where(F.col("_sum") != 0)
    scored = w.join(scores, "symbol").select(*by, "factor", (F.col("weight") * F.col("score")).alias("_x"))
    unknown = w.join(scores.select("symbol").distinct(), "symbol", "left_anti")
    lev = unknown.where(F.col("symbol").rlike("|".join(dims.LEVERAGED_MARKS)))
    fallback = dims.frame(spark, list(dims.LEVERAGED_SCORES.items()), "factor string, score double")
    extra = expand(lev, fallback).select(*by, "factor", (F.col("weight") * F.col("score")).alias("_x"))
    sums = scored.unionByName(extra).groupBy(*by, "factor").agg(F.sum("_x").alias("_x"))
    every = dims.frame(spark, [(f,) for f in dims.FACTORS], "factor string")
    grid = expand(total, every)
    df = grid.join(sums, [*by, "factor"], "left")
    return df.select(*by, "factor", F.round(F.coalesce(F.col("_x"), F.lit(0.0)) / F.col("_sum"), digits).alias("exposure"))


def returns_exposure(portfolio: DataFrame, factors: DataFrame, n: int = 60) -> DataFrame:
    """Rolling beta of portfolio(ts, ret) to each factor(ts, factor, ret)."""
    port = portfolio.select("ts", F.col("ret").alias("_port"))
    df = factors.join(port, "ts").select("factor", "ts", F.col("_port").alias("close"), F.col("ret").alias("_fac"))
    df = index_bars(df, keys=("factor",)).drop("_pc")
    out = feat.beta_correlation(df, n, keys=("factor",), x="close", y="_fac")
    return out.select("factor", "ts", F.col("rolling_beta").alias("exposure"))


def monthly_exposure(exposure: DataFrame) -> DataFrame:
    return exposure.groupBy("factor", F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.avg("exposure").alias("exposure"))
