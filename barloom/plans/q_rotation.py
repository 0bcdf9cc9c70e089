"""Rotation strategies, ensemble and ensemble portfolio."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from barloom.functions.scalars import rounded
from barloom.operators import performance as perf, rotation as rot
from barloom.operators.panel import panel, panel_returns
from barloom.plans import dims
from barloom.plans.catalog import query
from barloom.plans.sqltext import MARKET, PANEL, ema, r, roll, with_
from barloom.session import cut
from barloom.sources.derived import bars_market

PBY = "PARTITION BY symbol ORDER BY d"
_RET = f"pret AS (SELECT symbol, ts, d, close / lag(close) OVER ({PBY}) - 1 AS ret FROM panel)"
_BASKET = f"basket(strategy, state, symbol, weight) AS ({dims.values(dims.BASKETS)})"


def _top(src: str, n: str, direction: str = "DESC", name: str = "w") -> str:
    """CTE: equal weight over the n best scores per date."""
    return (f"{name}_c AS (SELECT *, count(*) OVER (PARTITION BY d) AS n FROM {src}), "
            f"{name}_r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score {direction} NULLS LAST, symbol) AS rk FROM {name}_c), "
            f"{name} AS (SELECT symbol, d, 1.0 / count(*) OVER (PARTITION BY d) AS weight, 1 AS signal FROM {name}_r WHERE rk <= {n})")


def _state(strategy: str, states: str) -> str:
    """CTE ``w``: normalised basket weights of a states(d, state) query."""
    return (f"st AS ({states}), bw AS (SELECT b.symbol, st.d, b.weight FROM st JOIN basket b ON b.state = st.state "
            f"AND b.strategy = '{strategy}' WHERE b.symbol IN (SELECT symbol FROM bars)), "
            "w AS (SELECT symbol, d, weight / sum(weight) OVER (PARTITION BY d) AS weight, 1 AS signal FROM bw)")


_OUT = (f"SELECT w.symbol, c.ts, {r('w.weight', 'weight')}, CAST(w.signal AS INT) AS signal FROM w JOIN cal c ON c.d = w.d + 1")

_RSI = f"""dd AS (SELECT symbol, d, close - lag(close) OVER ({PBY}) AS x FROM panel),
gg AS (SELECT symbol, d, CASE WHEN x > 0 THEN x ELSE 0.0 END AS up, CASE WHEN x < 0 THEN -x ELSE 0.0 END AS dn FROM dd),
sc AS (SELECT symbol, d, round(coalesce(100 - 100 / (1 + ({roll('avg(up)', 'up', 14, PBY)}) / nullif({roll('avg(dn)', 'dn', 14, PBY)}, 0)), 50), 10) AS score FROM gg)"""


def _ratio_sql(a: str, b: str) -> tuple[str, str]:
    return (f"ra AS (SELECT x.symbol, x.d, x.close / y.close AS ratio FROM panel x JOIN panel y ON x.d = y.d WHERE x.symbol = '{a}' AND y.symbol = '{b}')",
            ema("re", "ra", {"ma": ("ratio", 20)}, order="d", keep="ratio"))


def _ratio_states() -> str:
    return "SELECT cal.d, CASE WHEN coalesce(round(re.ratio - re.ma, 9) > 0, false) THEN 'rising' ELSE 'falling' END AS state FROM cal LEFT JOIN re ON re.d = cal.d"


_VIX = "vix AS (SELECT d, close AS v FROM panel WHERE symbol = 'VIXY')"

STRATEGY_SQL: dict[str, tuple[str, ...]] = {
    "RSI_Rotation": (_RSI, _top("sc", "5")),
    "Momentum_Rotation": (f"sm AS (SELECT symbol, d, round(lag(close, 21) OVER ({PBY}) / lag(close, 273) OVER ({PBY}) - 1, 10) AS score FROM panel)",
                          "sc AS (SELECT * FROM sm WHERE score IS NOT NULL)", _top("sc", "5")),
    "Golden_Cross": (ema("ge", "panel", {"f": ("close", 50), "s": ("close", 200)}, order="d"),
                     "w AS (SELECT symbol, d, 1.0 / count(*) OVER (PARTITION BY d) AS weight, 1 AS signal FROM ge WHERE round(f - s, 9) > 0)"),
    "XLU/SPY_Rotation": (*_ratio_sql("XLU", "SPY"), _BASKET, _state("XLU/SPY_Rotation", _ratio_states())),
    "QQQ/SPY_Rotation": (*_ratio_sql("QQQ", "SPY"), _BASKET, _state("QQQ/SPY_Rotation", _ratio_states())),
    "Credit_Rotation": (*_ratio_sql("HYG", "IEF"), _BASKET, _state("Credit_Rotation", _ratio_states())),
    "VIX_Rotation": (_VIX, _BASKET, _state("VIX_Rotation", "SELECT cal.d, CASE WHEN v < 18 THEN 'low' WHEN v >= 30 THEN 'high' ELSE 'mid' END AS state FROM cal LEFT JOIN vix USING (d)")),
    "Hedging_System": (_VIX, _BASKET, "w AS (SELECT b.symbol, d, weight, 1 AS signal FROM vix JOIN basket b ON b.strategy = 'Hedging_System' WHERE v > 25 AND b.symbol IN (SELECT symbol FROM bars))"),
    "Managed_Futures_Rotation": (
        ema("me", "panel", {"ma": ("close", 200)}, order="d", keep="close"),
        "ups AS (SELECT d, count(*) FILTER (round(close - ma, 9) > 0) AS n FROM me GROUP BY d)", _BASKET,
        _state("Managed_Futures_Rotation", "SELECT d, CASE WHEN n > (SELECT count(DISTINCT symbol) FROM bars) * 0.6 THEN 'trend' ELSE 'flat' END AS state FROM ups").replace(", w AS (", ", w0 AS ("),
        "w AS (SELECT symbol, d, sum(weight) AS weight, 1 AS signal FROM (SELECT symbol, d, weight FROM w0 UNION ALL SELECT symbol, d, 0.0 FROM me WHERE round(close - ma, 9) > 0) GROUP BY symbol, d)"),
    "Volatility_Rotation": (_RET, f"vs AS (SELECT symbol, d, round(({roll('stddev_samp(ret)', 'ret', 20, PBY)}) * sqrt(252.0), 10) AS score FROM pret)",
                            "sc AS (SELECT * FROM vs WHERE score IS NOT NULL)", _top("sc", "greatest(1, n // 5)", "ASC")),
    "Correlation_Rotation": (
        _RET, "cp AS (SELECT x.symbol, y.symbol AS other, x.d, x.ret AS rx, y.ret AS ry FROM pret x JOIN pret y ON x.d = y.d AND x.symbol <> y.symbol)",
        "cw AS (SELECT symbol, other, d, corr(rx, ry) OVER (PARTITION BY symbol, other ORDER BY d RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS c FROM cp)",
        "sc AS (SELECT symbol, d, round(coalesce(avg(c) FILTER (NOT isnan(c)), 0), 9) AS score FROM cw WHERE d >= 19 GROUP BY symbol, d)",
        _top("sc", "greatest(1, n // 3)", "ASC")),
    "Overnight_Drift": (
        f"oi AS (SELECT symbol, d, (open / lag(close) OVER ({PBY}) - 1) - (close / open - 1) AS x FROM panel)",
        f"os AS (SELECT symbol, d, round({roll('avg(x)', 'x', 504, PBY)}, 10) AS score FROM oi)",
        "sc AS (SELECT * FROM os WHERE score IS NOT NULL)",
        _top("sc", "greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT))", "DESC", "wt"),
        _top("sc", "greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT))", "ASC", "wb"),
        """w AS (SELECT symbol, d, -0.5 * weight AS weight, -1 AS signal FROM wb UNION ALL
  SELECT symbol, d, 0.5 * weight, 1 FROM wt WHERE (symbol, d) NOT IN (SELECT (symbol, d) FROM wb))"""),
    "Attention_Stocks": (
        f"av AS (SELECT symbol, d, {roll('avg(volume)', 'volume', 20, PBY)} AS v, close / lag(close, 20) OVER ({PBY}) - 1 AS r FROM panel)",
        "ax AS (SELECT d, avg(v) AS mv, stddev_samp(v) AS sv, avg(r) AS mr, stddev_samp(r) AS sr FROM av GROUP BY d)",
        """sc AS (SELECT symbol, d, round((v - mv) / (sv + 1e-8) + (r - mr) / (sr + 1e-8), 9) AS score FROM av JOIN ax USING (d)
  WHERE mv IS NOT NULL AND mr IS NOT NULL AND (v IS NOT NULL OR r IS NOT NULL))""",
        _top("sc", "greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT))")),
    "MeanReversion_Intraday": (
        _RET, f"mz AS (SELECT symbol, d, round((ret - ({roll('avg(ret)', 'ret', 20, PBY)})) / nullif({roll('stddev_samp(ret)', 'ret', 20, PBY)}, 0), 10) AS z FROM pret)",
        "w AS (SELECT symbol, d, 1.0 / count(*) OVER (PARTITION BY d) AS weight, 1 AS signal FROM mz WHERE z < -2)"),
    "Pairs_Trading_StatArb": (
        f"prs(k, a, b) AS ({dims.values([(i, a, b) for i, (a, b) in enumerate(dims.PAIRS)])})",
        "sp AS (SELECT k, a, b, x.d, x.close - y.close AS s FROM prs JOIN panel x ON x.symbol = a JOIN panel y ON y.symbol = b AND y.d = x.d)",
        f"pz AS (SELECT *, (s - ({roll('avg(s)', 's', 60, 'PARTITION BY k ORDER BY d')})) / nullif({roll('stddev_samp(s)', 's', 60, 'PARTITION BY k ORDER BY d')}, 0) AS z FROM sp)",
        "hot AS (SELECT k, a, b, d, CASE WHEN z > 2 THEN -1 ELSE 1 END AS s FROM pz WHERE z > 2 OR z < -2)",
        "legs AS (SELECT k, d, a AS symbol, s FROM hot UNION ALL SELECT k, d, b, -s FROM hot)",
        "w AS (SELECT symbol, d, 0.5 * max_by(s, k) AS weight, max_by(s, k) AS signal FROM legs GROUP BY symbol, d)"),
}

# query key per strategy
KEYS = {
    "m1_rsi_rotation": "RSI_Rotation", "m2_momentum_rotation": "Momentum_Rotation", "m3_golden_cross": "Golden_Cross",
    "m4_xlu_spy": "XLU/SPY_Rotation", "m5_qqq_spy": "QQQ/SPY_Rotation", "m6_credit": "Credit_Rotation",
    "m7_vix": "VIX_Rotation", "m8_managed_futures": "Managed_Futures_Rotation", "m9_volatility": "Volatility_Rotation",
    "m10_correlation": "Correlation_Rotation", "m11_overnight_drift": "Overnight_Drift", "m12_attention": "Attention_Stocks",
    "m13_mean_reversion": "MeanReversion_Intraday", "m14_hedging": "Hedging_System", "m15_pairs": "Pairs_Trading_StatArb",
}


def _register(key: str, name: str) -> None:
    @query(key, with_(MARKET, PANEL, *STRATEGY_SQL[name], recursive=True) + _OUT)
    def run(spark, sf_dir):
        w = rot.strategy_weights(panel(bars_market(spark, sf_dir)), name)
        return rounded(w.select("symbol", "ts", "weight", F.col("signal").cast("int").alias("signal")))


for _k, _n in KEYS.items():
    _register(_k, _n)


@query("c3_panel", with_(MARKET, PANEL) + f"SELECT symbol, ts, {r('close')}, volume FROM panel")
def c3(spark, sf_dir):
    return rounded(panel(bars_market(spark, sf_dir), ("close", "volume")).select("symbol", "ts", "close", "volume"))


ENSEMBLE = sorted(STRATEGY_SQL)
recursive = partial(with_, recursive=True)


def _prefixed(name: str, tag: str) -> tuple[str, ...]:
    import re
    ctes = STRATEGY_SQL[name]
    defined = set(re.findall(r"(?:^|[,)]\s*)(\w+)(?:\([\w, ]+\))? AS (?:MATERIALIZED )?\(", ", ".join(ctes)))
    out = ", ".join(ctes)
    for n in defined:
        out = re.sub(rf"(?<![\w.']){n}(?=(\([a-z, ]+\))? AS (MATERIALIZED )?\()|(?<=FROM ){n}\b|(?<=JOIN ){n}\b|\b{n}(?=\.)", f"{n}_{tag}", out)
    return (out,)


_ENS = tuple(c for i, n in enumerate(ENSEMBLE) for c in _prefixed(n, f"s{i}")) + (
    "allw AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, symbol, d + 1 AS d, weight FROM w_s{i}" for i, n in enumerate(ENSEMBLE)) + ")",
    "aw AS (SELECT a.* FROM allw a JOIN cal c USING (d))",
    f"mix AS (SELECT symbol, d, sum(weight) / {len(ENSEMBLE)} AS w FROM aw GROUP BY symbol, d)",
    "ens AS (SELECT symbol, d, w / CASE WHEN sum(w) OVER (PARTITION BY d) = 0 THEN 1 ELSE sum(w) OVER (PARTITION BY d) END AS weight FROM mix)",
    f"er AS (SELECT symbol, d, close / lag(close) OVER ({PBY}) - 1 AS ret FROM panel)",
    "port AS (SELECT c.ts, c.d, coalesce(sum(e.weight * coalesce(x.ret, 0)), 0) AS ret FROM cal c LEFT JOIN ens e USING (d) LEFT JOIN er x ON x.symbol = e.symbol AND x.d = c.d GROUP BY c.ts, c.d)",
)


def _ensemble(spark, sf_dir):
    p = panel(bars_market(spark, sf_dir))
    weights = rot.all_weights(p, ENSEMBLE)
    return p, weights, rot.ensemble(weights, rot.meta_weights(spark, ENSEMBLE))


@query("m16_ensemble", recursive(MARKET, PANEL, *_ENS) + f"SELECT symbol, c.ts, {r('weight')} FROM ens JOIN cal c USING (d)")
def m16(spark, sf_dir):
    return rounded(_ensemble(spark, sf_dir)[2].select("symbol", "ts", "weight"))


@query("c9_portfolio_returns", recursive(MARKET, PANEL, *_ENS) + f"SELECT ts, {r('ret')} FROM port")
def c9(spark, sf_dir):
    p, _, ens = _ensemble(spark, sf_dir)
    return rounded(rot.portfolio_returns(ens, panel_returns(p), p.select("d", "ts").distinct()).select("ts", "ret"))


@query("i15_ensemble_portfolio", recursive(MARKET, PANEL, *_ENS, "pe AS (SELECT ts, d, ret, product(1 + ret) OVER (ORDER BY d) AS eq FROM port)",
       "pk AS (SELECT *, eq / max(eq) OVER (ORDER BY d) - 1 AS dd FROM pe)") + f"""SELECT {r('product(1 + ret) - 1', 'total_return', 5)},
  {r("pow(product(1 + ret), 365.25 / (max(ts) - min(ts))) - 1", 'cagr', 5)}, {r('avg(ret) / stddev_samp(ret) * sqrt(252.0)', 'sharpe', 5)},
  {r('avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(252.0)', 'sortino', 5)}, {r('min(dd)', 'max_dd', 5)} FROM pk""")
def i15(spark, sf_dir):
    p, _, ens = _ensemble(spark, sf_dir)
    port = cut(rot.portfolio_returns(ens, panel_returns(p), p.select("d", "ts").distinct()).withColumn("series_id", F.lit("ensemble")))
    stats = port.groupBy("series_id").agg(
        F.datediff(F.max("ts"), F.min("ts")).alias("_days"), perf.sharpe("ret").alias("sharpe"), perf.sortino("ret").alias("sortino"))
    df = stats.join(perf.max_drawdown(port, ["series_id"]), "series_id")
    cagr = F.pow(F.col("total_return") + 1, F.lit(365.25) / F.col("_days")) - 1
    return rounded(df.select("total_return", cagr.alias("cagr"), "sharpe", "sortino", "max_dd"), 5)


@query("d26_diversification", recursive(MARKET, PANEL, *_ENS,
       "sr AS (SELECT strategy, a.d, sum(weight * coalesce(ret, 0)) AS ret FROM aw a JOIN er USING (symbol, d) GROUP BY strategy, a.d)",
       "sg AS (SELECT s.strategy, c.d, coalesce(sr.ret, 0) AS ret FROM (SELECT DISTINCT strategy FROM sr) s JOIN cal c ON true LEFT JOIN sr ON sr.strategy = s.strategy AND sr.d = c.d)",
       "cc AS (SELECT corr(a.ret, b.ret) AS c FROM sg a JOIN sg b ON a.d = b.d AND a.strategy <> b.strategy GROUP BY a.strategy, b.strategy)") +
       f"""SELECT {len(ENSEMBLE)}::BIGINT AS num_systems, {r('avg(c)', 'avg_correlation', 5)},
  {r(f'sqrt({len(ENSEMBLE)}) / sqrt(1 + ({len(ENSEMBLE)} - 1) * avg(c))', 'diversification_ratio', 5)} FROM cc""")
def d26(spark, sf_dir):
    p, weights, _ = _ensemble(spark, sf_dir)
    sr = cut(rot.strategy_returns(weights, panel_returns(p)))
    return rounded(rot.diversification(sr, p.select("d").distinct()), 5)


_EXP = "ex(strategy, base, er, ev, hr, tv) AS (" + dims.values(dims.STRATEGIES) + ")"


@query("d27_strategy_contribution", recursive(MARKET, PANEL, *_ENS, _EXP,
       f"rc AS (SELECT strategy, sum(weight * coalesce(ret, 0)) / {len(ENSEMBLE)} AS realised FROM aw JOIN er USING (symbol, d) GROUP BY strategy)") +
       f"SELECT strategy, {r('er / sum(er) OVER ()', 'contribution')}, {r('realised')} FROM rc JOIN ex USING (strategy)")
def d27(spark, sf_dir):
    from barloom.operators.timeline import attach
    p, weights, _ = _ensemble(spark, sf_dir)
    facts = dims.frame(spark, [(s[0], s[2]) for s in dims.STRATEGIES], "strategy string, expected_return double")
    share = rot.meta_weights(spark, ENSEMBLE).join(facts, "strategy").withColumn("_x", F.col("meta_weight") * F.col("expected_return"))
    share = attach(share, share.agg(F.sum("_x").alias("_total")))
    sr = rot.strategy_returns(weights, panel_returns(p)).groupBy("strategy").agg(F.sum("ret").alias("_r"))
    return rounded(share.join(sr, "strategy").select("strategy", F.try_divide("_x", "_total").alias("contribution"),
                                                     (F.col("_r") * F.col("meta_weight")).alias("realised")))


@query("d35_exposure_turnover", recursive(MARKET, PANEL, *_ENS,
       "tw AS (SELECT symbol, d, weight FROM ens)",
       "dl AS (SELECT d, abs(weight) AS a, 0.0::DOUBLE AS t FROM tw UNION ALL SELECT coalesce(x.d, y.d + 1), 0.0, abs(coalesce(x.weight, 0) - coalesce(y.weight, 0)) FROM tw x FULL JOIN tw y ON x.symbol = y.symbol AND x.d = y.d + 1)") +
       f"SELECT c.ts, {r('sum(a)', 'exposure')}, {r('sum(t)', 'turnover')} FROM dl JOIN cal c USING (d) GROUP BY c.ts")
def d35(spark, sf_dir):
    p, _, ens = _ensemble(spark, sf_dir)
    from barloom.operators.portfolio import exposure_turnover
    return rounded(exposure_turnover(cut(ens), p.select("d", "ts").distinct()).select("ts", "exposure", "turnover"))
