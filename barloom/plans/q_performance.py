"""Performance, tail risk, distributions, costs and stress."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import norm_cdf, rounded
from barloom.operators import backtest as bt, features as feat, performance as perf, signals as sig, validation as val
from barloom.plans import dims
from barloom.plans.catalog import query
from barloom.plans.inputs import brand
from barloom.plans.q_signals import EMA_CROSS, SIGNAL_CTES, _machine, _renamed
from barloom.plans.sqltext import BRAND, BY, r, with_
from barloom.session import cut
from barloom.sources.derived import bars_brand, table

RET = f"rr AS (SELECT symbol, ts, close, close / lag(close) OVER ({BY}) - 1 AS ret, close / max(close) OVER ({BY}) - 1 AS dd, row_number() OVER ({BY}) - 1 AS i FROM bars)"


def phi(x: str) -> str:
    """Normal CDF by the same published polynomial."""
    z = f"(abs({x}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911 * {z}))"
    poly = f"(((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t})"
    return f"(0.5 * (1 + CASE WHEN {x} < 0 THEN -1 ELSE 1 END * (1 - {poly} * exp(-{z} * {z}))))"


_PERF = f"""pf AS (SELECT symbol, count(ret) AS n, max(ts) - min(ts) AS days, min_by(close, ts) AS v0, max_by(close, ts) AS v1, avg(ret) AS m, stddev_samp(ret) AS s,
  CASE WHEN count(*) FILTER (ret < 0) > 1 THEN stddev_samp(ret) FILTER (ret < 0) ELSE stddev_samp(ret) END AS ds, min(dd) AS max_dd,
  count(*) FILTER (ret > 0) * 100.0 / count(ret) AS win_rate, sum(ret) FILTER (ret > 0) / nullif(abs(sum(ret) FILTER (ret < 0)), 0) AS profit_factor,
  skewness(ret) * (count(ret) - 2) / sqrt(count(ret) * (count(ret) - 1.0)) AS g3, kurtosis_pop(ret) + 3 AS g4 FROM rr GROUP BY symbol),
p2 AS (SELECT *, m / s * sqrt(252.0) AS sharpe, m / s AS sr1, m / ds * sqrt(252.0) AS sortino, pow(v1 / v0, 365.25 / days) - 1 AS cagr FROM pf)"""


def _psr(sr: str, bench: float = 0.0) -> str:
    inner = f"(1 - g3 * {sr} + (g4 - 1) / 4 * {sr} * {sr})"
    return phi(f"(({sr} - {bench!r}) * sqrt(n - 1.0) / CASE WHEN {inner} > 0 THEN sqrt({inner}) ELSE 1 END)")


def _curve(spark, sf_dir):
    return brand(spark, sf_dir).select("symbol", "ts", "close")


@query("d6_performance", with_(BRAND, RET, _PERF) + f"""SELECT symbol, {r('v1 / v0 - 1', 'total_return')}, {r('cagr')}, {r('sharpe')}, {r('sortino')}, {r('max_dd')},
  {r('win_rate')}, {r('profit_factor')}, {r('s * sqrt(252.0)', 'annual_vol')}, {r('cagr / abs(max_dd)', 'calmar')} FROM p2""")
def d6(spark, sf_dir):
    m = perf.metrics(_curve(spark, sf_dir), ("symbol",), "close")
    return rounded(m.select("symbol", "total_return", "cagr", "sharpe", "sortino", "max_dd", "win_rate", "profit_factor", "annual_vol", "calmar"))


@query("d7_performance_bar_years", with_(BRAND, RET, _PERF) + f"SELECT symbol, {r('pow(v1 / v0, 252.0 / n) - 1', 'cagr')}, {r('sharpe')}, {r('g3', 'skewness')}, {r('g4', 'kurtosis')} FROM p2")
def d7(spark, sf_dir):
    m = perf.metrics(_curve(spark, sf_dir), ("symbol",), "close", "bars")
    return rounded(m.select("symbol", "cagr", "sharpe", "skewness", "kurtosis"))


@query("d8_summary_metrics", with_(BRAND, RET, _PERF) + f"""SELECT symbol, {r('v1 / v0 - 1', 'total_return')}, {r('cagr')}, {r('sharpe')}, {r('max_dd', 'maxdd')},
  {r('s * sqrt(252.0)', 'vol')}, {r('v1', 'final_equity')} FROM p2""")
def d8(spark, sf_dir):
    return rounded(perf.summary_metrics(_curve(spark, sf_dir), ("symbol",), "close"))


@query("d9_probabilistic_sharpe", with_(BRAND, RET, _PERF) + f"SELECT symbol, {r(_psr('sharpe'), 'psr_annualised')}, {r(_psr('sr1'), 'psr')} FROM p2")
def d9(spark, sf_dir):
    return rounded(perf.metrics(_curve(spark, sf_dir), ("symbol",), "close").select("symbol", "psr_annualised", "psr"))


@query("d10_deflated_sharpe", with_(BRAND, RET, _PERF) + f"SELECT symbol, {r(_psr('sharpe', perf.deflated_threshold(10)), 'dsr_annualised')} FROM p2")
def d10(spark, sf_dir):
    return rounded(perf.metrics(_curve(spark, sf_dir), ("symbol",), "close").select("symbol", "dsr_annualised"))


def _tails(spark, sf_dir):
    return perf.tail_metrics(feat.returns(brand(spark, sf_dir)).select("symbol", "ret"), ("symbol",))


_Q = "qs AS (SELECT symbol, quantile_cont(ret, 0.05) AS q05, quantile_cont(ret, 0.01) AS q01, quantile_cont(ret, 0.95) AS q95 FROM rr GROUP BY symbol)"


@query("d12_value_at_risk", with_(BRAND, RET, _Q) + f"SELECT symbol, {r('-q05', 'var_95')}, {r('-q01', 'var_99')} FROM qs")
def d12(spark, sf_dir):
    return rounded(_tails(spark, sf_dir).select("symbol", "var_95", "var_99"))


@query("d13_conditional_var", with_(BRAND, RET, _Q) + f"""SELECT symbol, {r('-avg(ret) FILTER (ret <= q05)', 'cvar_95')}, {r('-avg(ret) FILTER (ret <= q01)', 'cvar_99')}
  FROM rr JOIN qs USING (symbol) GROUP BY symbol""")
def d13(spark, sf_dir):
    return rounded(_tails(spark, sf_dir).select("symbol", "cvar_95", "cvar_99"))


@query("d14_ulcer_index", with_(BRAND, RET) + f"SELECT symbol, {r('sqrt(avg(dd * 100 * dd * 100))', 'ulcer_index')} FROM rr GROUP BY symbol")
def d14(spark, sf_dir):
    return rounded(perf.ulcer_index(_curve(spark, sf_dir), ("symbol",), "close"))


@query("d15_tail_ratio", with_(BRAND, RET, _Q) + f"SELECT symbol, {r('q95 / abs(q05)', 'tail_ratio')} FROM qs")
def d15(spark, sf_dir):
    return rounded(_tails(spark, sf_dir).select("symbol", "tail_ratio"))


@query("d16_skew_kurtosis", with_(BRAND, RET) + f"SELECT symbol, {r('skewness(ret)', 'skew')}, {r('kurtosis(ret)', 'kurtosis')} FROM rr GROUP BY symbol")
def d16(spark, sf_dir):
    return rounded(_tails(spark, sf_dir).select("symbol", "skew", "kurtosis"))


@query("d12_percentiles_of_prices", f"""SELECT l_returnflag AS flag, {r('quantile_cont(l_extendedprice, 0.5)', 'p50', 4)}, {r('quantile_cont(l_extendedprice, 0.99)', 'p99', 4)}
  FROM lineitem GROUP BY l_returnflag""")
def d12b(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return rounded(perf.exact_percentiles(df, ["flag"], "l_extendedprice", {"p50": 0.5, "p99": 0.99}), 4)


@query("d18_monthly_returns", with_(BRAND, RET) + f"""SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS period, {r('product(1 + coalesce(ret, 0)) - 1', 'ret')}
  FROM rr GROUP BY symbol, date_trunc('month', ts)""")
def d18(spark, sf_dir):
    return rounded(perf.periodic_returns(feat.returns(brand(spark, sf_dir)), "month", ("symbol",)))


@query("d18_month_year_table", with_(BRAND, RET, "mo AS (SELECT symbol, date_trunc('month', ts) AS p, product(1 + coalesce(ret, 0)) - 1 AS ret FROM rr GROUP BY symbol, date_trunc('month', ts))") +
       "SELECT symbol, CAST(month(p) AS INT) AS month, " + ", ".join(r(f"max(ret) FILTER (year(p) = {y})", f"y{y}") for y in range(1996, 2000)) + " FROM mo GROUP BY symbol, month(p)")
def d18b(spark, sf_dir):
    return rounded(perf.month_year_table(feat.returns(brand(spark, sf_dir)), list(range(1996, 2000)), ("symbol",)))


@query("d34_return_histogram", with_(BRAND, RET, "rg AS (SELECT symbol, min(ret) AS lo, max(ret) AS hi FROM rr GROUP BY symbol)") +
       f"""SELECT symbol, bin, count(*) AS n, {r('max(lo + bin * (hi - lo) / 50)', 'left_edge')} FROM (SELECT rr.symbol, lo, hi, CAST(least(49, floor((ret - lo) / (hi - lo) * 50)) AS INT) AS bin
  FROM rr JOIN rg USING (symbol) WHERE ret IS NOT NULL) GROUP BY symbol, bin""")
def d34(spark, sf_dir):
    rets = cut(feat.returns(brand(spark, sf_dir)).select("symbol", "ret"))
    return rounded(perf.histogram(rets, 50, ("symbol",)))


_SC = "sc(name, s, e) AS (" + dims.values(dims.SCENARIOS + [("1998", "1998-01-01", "1998-12-31")]) + ")"


def scenarios(spark):
    return dims.frame(spark, dims.SCENARIOS + [("1998", "1998-01-01", "1998-12-31")], "name string, s string, e string").select(
        "name", F.col("s").cast("date").alias("start"), F.col("e").cast("date").alias("end"))


@query("d28_historical_stress", with_(BRAND, _SC, "ins AS (SELECT symbol, ts, close, name FROM bars JOIN sc ON ts BETWEEN CAST(s AS DATE) AND CAST(e AS DATE))",
       "dd AS (SELECT *, close / max(close) OVER (PARTITION BY symbol, name ORDER BY ts) - 1 AS dd FROM ins)",
       "ag AS (SELECT symbol, name, max_by(close, ts) / min_by(close, ts) - 1 AS tr, min(dd) AS md FROM dd GROUP BY symbol, name)") +
       f"SELECT b.symbol, sc.name, {r('tr', 'total_return')}, {r('md', 'max_dd')} FROM (SELECT DISTINCT symbol FROM bars) b CROSS JOIN sc LEFT JOIN ag ON ag.symbol = b.symbol AND ag.name = sc.name")
def d28(spark, sf_dir):
    curve = cut(bars_brand(spark, sf_dir).select("symbol", "ts", "close"))
    return rounded(val.historical_stress(curve, scenarios(spark), ("symbol",), "close"))


@query("c8_window_join", with_(BRAND, _SC) + "SELECT name, symbol, count(*) AS bars FROM bars JOIN sc ON ts BETWEEN CAST(s AS DATE) AND CAST(e AS DATE) GROUP BY name, symbol")
def c8(spark, sf_dir):
    from barloom.operators.joins import join_windows
    sc = dims.frame(spark, dims.SCENARIOS + [("1998", "1998-01-01", "1998-12-31")], "name string, s string, e string").select(
        "name", F.col("s").cast("date").alias("start"), F.col("e").cast("date").alias("end"))
    df = join_windows(bars_brand(spark, sf_dir).select("symbol", "ts"), sc)
    return df.groupBy("name", "symbol").agg(F.count(F.lit(1)).alias("bars"))


_SHOCK = [("volatility", 2.0), ("rate", 2.0), ("correlation", 1.5)]


@query("d29_synthetic_stress", with_(BRAND, RET, "sh(shock, factor) AS (" + dims.values(_SHOCK) + ")", "nn AS (SELECT symbol, max(i) + 1 AS n FROM rr GROUP BY symbol)",
       """st AS (SELECT rr.symbol, ts, shock, factor, coalesce(ret, 0) AS ret, CASE shock WHEN 'volatility' THEN coalesce(ret, 0) * factor
  WHEN 'rate' THEN coalesce(ret, 0) - CASE WHEN i >= n - 60 THEN 0.01 * factor / 252 ELSE 0 END ELSE coalesce(ret, 0) * (1 + (factor - 1) * 0.5) END AS x FROM rr JOIN nn USING (symbol) CROSS JOIN sh)""",
       "eq AS (SELECT *, product(1 + x) OVER (PARTITION BY symbol, shock ORDER BY ts) AS eq FROM st)",
       "dw AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol, shock ORDER BY ts) - 1 AS dw FROM eq)") +
       f"""SELECT symbol, shock, factor, {r('max_by(eq, ts) - 1', 'total_return')}, {r('min(dw)', 'max_dd')}, {r('stddev_samp(x) * sqrt(252.0)', 'volatility')},
  {r('stddev_samp(ret) * sqrt(252.0)', 'original_volatility')} FROM dw GROUP BY symbol, shock, factor""")
def d29(spark, sf_dir):
    rets = feat.returns(brand(spark, sf_dir)).withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    return rounded(val.synthetic_stress(rets, _SHOCK))


_GROSS = (*EMA_CROSS, *_machine(0), f"""gr AS (SELECT symbol, ts, coalesce(lag(position) OVER ({BY}), 0) * coalesce(close / lag(close) OVER ({BY}) - 1, 0) AS ret,
  coalesce(abs(position - lag(position) OVER ({BY})), 0)::DOUBLE AS turnover FROM pos)""")


def _costs(bps: list[float]) -> tuple[str, ...]:
    return (*_GROSS, f"cl AS (SELECT unnest({bps}) ::DOUBLE AS bps)",
            """cv AS (SELECT symbol, bps, pow(product(1 + ret - turnover * bps / 10000), 252.0 / count(*)) - 1 AS cagr,
  coalesce(avg(ret - turnover * bps / 10000) / nullif(stddev_samp(ret - turnover * bps / 10000), 0), 0) * sqrt(252.0) AS sharpe, avg(turnover) AS turnover
  FROM gr CROSS JOIN cl GROUP BY symbol, bps)""")


def _gross(spark, sf_dir):
    pos = bt.state_position(sig.ema_cross(brand(spark, sf_dir)), 0)
    return cut(bt.strategy_returns(pos, cost=0.0).select("symbol", "ts", "ret", "turnover"))


BPS = [0, 2, 5, 10, 20, 50, 100]


@query("i16_cost_curve", with_(BRAND, *_costs(BPS), recursive=True) + f"SELECT symbol, bps, {r('cagr')}, {r('sharpe')}, {r('turnover')} FROM cv")
def i16(spark, sf_dir):
    return rounded(val.cost_curve(_gross(spark, sf_dir), BPS))


@query("i16_cost_sensitivity", with_(BRAND, *_costs(BPS), recursive=True) + "SELECT symbol, " + ", ".join(
    r(f"CASE WHEN avg({c}) = 0 THEN 0 ELSE (max({c}) - min({c})) / (abs(avg({c})) + 1e-8) END", f"{c}_sensitivity", 4) for c in ("cagr", "sharpe", "turnover")) + " FROM cv GROUP BY symbol")
def i16b(spark, sf_dir):
    return rounded(val.cost_sensitivity(val.cost_curve(_gross(spark, sf_dir), BPS)), 4)


def _levels(test: str, commission: float) -> str:
    curve = _costs(val.LEVELS)[-1].replace("bps / 10000", f"(bps + {commission}) / 10000")
    return (f"SELECT symbol, '{test}' AS test, max(sharpe) FILTER (bps = 2) AS o, avg(sharpe) AS m, min(sharpe) AS w "
            f"FROM {curve.removeprefix('cv AS ')} GROUP BY symbol")


@query("v9_cost_robustness", with_(BRAND, *_costs(val.LEVELS)[:-1], "lv AS (" + _levels("Transaction Cost Sensitivity", 0) + " UNION ALL " + _levels("Slippage Sensitivity", 2) + ")",
       recursive=True) + f"""SELECT symbol, test, {r('o', 'original')}, {r('m', 'mean_stressed')}, {r('w', 'worst_case')},
  {r('greatest(0, least(10, 10 * (1 - abs(o - w) / (abs(o) + 1))))', 'robustness_score')} FROM lv""")
def v9(spark, sf_dir):
    """Levels of commission, and levels of slippage on top of a commission of two basis points."""
    gross = _gross(spark, sf_dir)
    cost = val.cost_robustness(val.cost_curve(gross, val.LEVELS), "Transaction Cost Sensitivity")
    return rounded(cost.unionByName(val.cost_robustness(val.cost_curve(gross, val.LEVELS, commission=2.0), "Slippage Sensitivity")))


_F5 = tuple(c for _, tag, ctes, names in SIGNAL_CTES for c in (
    *_renamed(ctes, tag, names), *_renamed(_machine(0), tag, "seq pos cond")))
_F5N = {tag: name for name, tag, _, _ in SIGNAL_CTES}


@query("f5_best_strategy", with_(BRAND, *_F5, "al AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, symbol, ts, close, position FROM pos_{t}" for t, n in _F5N.items()) + ")",
       """sr AS (SELECT *, coalesce(close / lag(close) OVER w - 1, 0) AS ar, lag(position) OVER w AS pp FROM al WINDOW w AS (PARTITION BY strategy, symbol ORDER BY ts))""",
       """sc AS (SELECT strategy, symbol, coalesce(avg(coalesce(pp, 0) * ar - coalesce(abs(position - pp), 0) * 0.0005) /
  nullif(stddev_samp(coalesce(pp, 0) * ar - coalesce(abs(position - pp), 0) * 0.0005), 0), 0) * sqrt(252.0) AS sharpe FROM sr GROUP BY strategy, symbol)""",
       "rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe, 9) DESC, strategy) AS k FROM sc)", recursive=True) +
       f"SELECT symbol, strategy, {r('sharpe')} FROM rk WHERE k = 1")
def f5(spark, sf_dir):
    bars = brand(spark, sf_dir)
    out = None
    for name in sorted(_F5N.values()):
        rets = bt.strategy_returns(bt.state_position(sig.REGISTRY[name](bars), 0))
        one = rets.groupBy("symbol").agg(perf.sharpe("ret").alias("sharpe")).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("symbol").agg(F.min_by(F.struct("strategy", "sharpe"), F.struct(-F.round("sharpe", 9), F.col("strategy"))).alias("_b"))
    return rounded(best.select("symbol", "_b.strategy", "_b.sharpe"))


@query("h10_normal_cdf", f"SELECT o_orderkey, {r(phi('(o_totalprice / 100000 - 2)'), 'cdf')} FROM orders")
def h10(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(norm_cdf(F.col("o_totalprice") / 100000 - 2), 6).alias("cdf"))


@query("j1_named_metrics", with_(BRAND, RET) + f"""SELECT symbol, {r('avg(ret) / stddev_samp(ret) * sqrt(252.0)', 'sharpe')},
  {r('avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(252.0)', 'sortino')}, {r('stddev_samp(ret) * sqrt(252.0)', 'annual_vol')},
  {r('count(*) FILTER (ret > 0) * 100.0 / count(ret)', 'win_rate')}, {r('sum(ret) FILTER (ret > 0) / abs(sum(ret) FILTER (ret < 0))', 'profit_factor')},
  {r('product(1 + coalesce(ret, 0)) - 1', 'total_return')}, {r('avg(ret)', 'mean_return')} FROM rr GROUP BY symbol""")
def j1(spark, sf_dir):
    rets = feat.returns(brand(spark, sf_dir))
    return rounded(rets.groupBy("symbol").agg(*[m("ret").alias(n) for n, m in perf.METRICS.items()]))
