"""Portfolio construction, risk decomposition and factor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import rounded
from barloom.operators import factors as fac, features as feat, performance as perf, portfolio as pf
from barloom.operators.panel import panel, panel_returns
from barloom.operators.timeline import attach
from barloom.plans import dims
from barloom.plans.catalog import query
from barloom.plans.inputs import market
from barloom.plans.sqltext import BY, MARKET, PANEL, r, roll, with_
from barloom.session import cut
from barloom.sources.derived import bars_market

RET = f"rr AS (SELECT symbol, ts, close, close / lag(close) OVER ({BY}) - 1 AS ret FROM bars)"
_MONTH_END = f"""vv AS (SELECT symbol, ts, ({roll('stddev_samp(ret)', 'ret', 60)}) * sqrt(252.0) AS vol FROM rr),
vm AS (SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS ts, max_by(vol, ts) AS vol FROM vv WHERE vol IS NOT NULL GROUP BY symbol, date_trunc('month', ts))"""
CASH, LOW, HIGH = 0.05, 0.01, 0.1


def _constrain(raw: str, src: str, name: str = "w", keep: str = "") -> str:
    """CTEs: clip raw weights and rescale each date to 1 - cash."""
    return (f"{name}_c AS (SELECT ts, symbol, greatest({LOW}, least({HIGH}, {raw})) AS c{keep} FROM {src}), "
            f"{name} AS (SELECT ts, symbol, CASE WHEN sum(c) OVER (PARTITION BY ts) = 0 THEN {1 - CASH} / count(*) OVER (PARTITION BY ts) "
            f"ELSE c * {1 - CASH} / sum(c) OVER (PARTITION BY ts) END AS weight{keep} FROM {name}_c)")


def _vols(spark, sf_dir):
    """Month-end 60-bar volatility per symbol."""
    df = feat.compute(market(spark, sf_dir), {"vol": feat.rolling_volatility(60)})
    return df.where(F.col("vol").isNotNull()).groupBy("symbol", F.date_trunc("month", "ts").cast("date").alias("m")).agg(
        F.max_by("vol", "ts").alias("vol")).withColumnRenamed("m", "ts")


_INV = f"iv AS (SELECT ts, symbol, vol, (1 / vol) / sum(1 / vol) OVER (PARTITION BY ts) * {1 - CASH} AS raw FROM vm WHERE vol > 0)"
_OUT = f"SELECT ts, symbol, {r('weight')} FROM w"


@query("p1_weight_constraints", with_(MARKET, "vw AS (SELECT ts, symbol, sqrt(volume) / sum(sqrt(volume)) OVER (PARTITION BY ts) AS raw FROM bars)", _constrain("raw", "vw")) + f"SELECT ts, symbol, {r('weight', digits=7)} FROM w")
def p1(spark, sf_dir):
    bars = cut(bars_market(spark, sf_dir).select("ts", "symbol", F.sqrt("volume").alias("volume")))
    total = bars.groupBy("ts").agg(F.sum("volume").alias("_t"))
    w = bars.join(total, "ts").select("ts", "symbol", (F.col("volume") / F.col("_t")).alias("weight"))
    return rounded(pf.constrain(w, LOW, HIGH, CASH), 7)


@query("p2_equal_weight", with_(MARKET) + f"SELECT ts, symbol, {r(f'{1 - CASH} / count(*) OVER (PARTITION BY ts)', 'weight')} FROM bars")
def p2(spark, sf_dir):
    return rounded(pf.equal_weight(cut(bars_market(spark, sf_dir).select("ts", "symbol")), CASH))


@query("p3_inverse_volatility", with_(MARKET, RET, _MONTH_END, _INV, _constrain("raw", "iv")) + _OUT)
def p3(spark, sf_dir):
    return rounded(pf.inverse_volatility(cut(_vols(spark, sf_dir)), CASH, LOW, HIGH).select("ts", "symbol", "weight"))


@query("p5_volatility_targeting", with_(MARKET, RET, _MONTH_END, _INV, _constrain("raw", "iv")) + _OUT)
def p5(spark, sf_dir):
    return rounded(pf.volatility_targeting(cut(_vols(spark, sf_dir)), 0.15, CASH, LOW, HIGH).select("ts", "symbol", "weight"))


@query("p8_dynamic_sizing", with_(MARKET, RET, _MONTH_END, "sc AS (SELECT ts, symbol, greatest(0.2, least(1.5, 1 / vol)) AS s FROM vm WHERE vol > 0)",
       f"rw AS (SELECT ts, symbol, s / sum(s) OVER (PARTITION BY ts) * {1 - CASH} AS raw FROM sc)", _constrain("raw", "rw")) + _OUT)
def p8(spark, sf_dir):
    v = cut(_vols(spark, sf_dir).where(F.col("vol") > 0)).withColumn("weight", F.lit(1.0))
    return rounded(pf.dynamic_sizing(v, F.col("vol"), CASH, LOW, HIGH).select("ts", "symbol", "weight"))


_YEARS = "yr AS (SELECT year(ts) AS y, symbol, ts, ret FROM rr WHERE ret IS NOT NULL)"


def _yearly_moments(spark, sf_dir):
    """Covariance and mean per calendar year: one matrix per rebalance date."""
    bars = market(spark, sf_dir)
    rets = feat.returns(bars).select(F.year("ts").alias("y"), "symbol", F.datediff("ts", F.lit("1970-01-01").cast("date")).alias("d"), "ret")
    return cut(pf.covariance(cut(rets), keys=("y",)))


STEPS, DAMPING = 100, 0.5
_PARITY = ("cy AS (SELECT a.y, a.symbol AS a, b.symbol AS b, covar_samp(a.ret, b.ret) * 252 AS c FROM yr a JOIN yr b ON a.ts = b.ts GROUP BY a.y, a.symbol, b.symbol)",
           "cr AS (SELECT y, a, list(c ORDER BY b) AS row FROM cy GROUP BY y, a)",
           "cm AS MATERIALIZED (SELECT y, list(row ORDER BY a) AS m, list(a ORDER BY a) AS names, count(*) AS n FROM cr GROUP BY y)",
           f"""it AS (SELECT y, 0 AS k, list_transform(names, lambda x: 1.0::DOUBLE / n) AS w FROM cm UNION ALL
  SELECT y, k + 1, list_transform(q, lambda x: x / list_sum(q)) FROM (SELECT y, k,
    list_transform(list_zip(w, g), lambda p: p[1] * pow(v / n / greatest(p[1] * p[2] / v, 1e-8), {DAMPING}::DOUBLE)) AS q FROM (
    SELECT *, sqrt(list_dot_product(w, g)) AS v FROM (
      SELECT it.y, k, n, w, list_transform(m, lambda r: list_dot_product(r, w)) AS g FROM it JOIN cm USING (y) WHERE k < {STEPS}))))""",
           f"fw AS (SELECT y, unnest(names) AS symbol, unnest(w) * {1 - CASH} AS raw FROM it JOIN cm USING (y) WHERE k = {STEPS})",
           "fc AS (SELECT y, symbol, greatest(0, least(1, raw)) AS c FROM fw)")


@query("p4_risk_parity", with_(MARKET, RET, _YEARS, *_PARITY, recursive=True) + f"SELECT y, symbol, {r(f'c * {1 - CASH} / sum(c) OVER (PARTITION BY y)', 'weight', 5)} FROM fc")
def p4(spark, sf_dir):
    return rounded(pf.risk_parity(_yearly_moments(spark, sf_dir), CASH, STEPS, 0.0, 1.0, by=("y",), damping=DAMPING), 5)


_KELLY = ("mu AS (SELECT y, list(m ORDER BY symbol) AS mu FROM (SELECT y, symbol, avg(ret) * 252 AS m FROM yr GROUP BY y, symbol) GROUP BY y)",
          """ga AS (SELECT y, 0 AS k, n, list_transform(list_zip(m, mu), lambda z: list_append(z[1], z[2])) AS m FROM cm JOIN mu USING (y) UNION ALL
  SELECT y, k + 1, n, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / r[k + 1])
    ELSE list_transform(list_zip(r, m[k + 1]), lambda z: z[1] - r[k + 1] / m[k + 1][k + 1] * z[2]) END) FROM ga WHERE k < n)""",
          "kx AS (SELECT y, list_transform(m, lambda r: greatest(0, r[n + 1] * 0.5)) AS w, n FROM ga WHERE k = n)",
          f"""kw AS (SELECT y, unnest(names) AS symbol, unnest(list_transform(w, lambda x: CASE WHEN list_sum(w) = 0 THEN 0.5 / kx.n WHEN list_sum(w) > 1
  THEN x / list_sum(w) * {1 - CASH} ELSE x END)) AS raw FROM kx JOIN cm USING (y))""",
          "kc AS (SELECT y, symbol, greatest(0, least(1, raw)) AS c FROM kw)")


@query("p7_kelly", with_(MARKET, RET, _YEARS, *_PARITY[:3], *_KELLY, recursive=True) +
       f"SELECT y, symbol, {r(f'c * {1 - CASH} / sum(c) OVER (PARTITION BY y)', 'weight', 5)} FROM kc")
def p7(spark, sf_dir):
    return rounded(pf.kelly(_yearly_moments(spark, sf_dir), 0.5, CASH, 0.0, 1.0, by=("y",)), 5)


@query("d17_covariance", with_(MARKET, RET, _YEARS) + f"""SELECT a.y, a.symbol AS a, b.symbol AS b, {r('covar_samp(a.ret, b.ret) * 252', 'cov')} FROM yr a
  JOIN yr b ON a.ts = b.ts AND a.symbol <= b.symbol GROUP BY a.y, a.symbol, b.symbol""")
def d17(spark, sf_dir):
    return rounded(_yearly_moments(spark, sf_dir).select("y", "a", "b", "cov"))


_PANEL_RET = "pr AS (SELECT symbol, ts, d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS ret FROM panel), pr2 AS (SELECT * FROM pr WHERE ret IS NOT NULL)"
_RISK = ("ws AS (SELECT symbol, count(*)::DOUBLE / sum(count(*)) OVER () AS w FROM bars GROUP BY symbol)",
         "cv AS (SELECT a.symbol AS i, b.symbol AS j, covar_samp(a.ret, b.ret) * 252 AS c FROM pr2 a JOIN pr2 b ON a.d = b.d GROUP BY a.symbol, b.symbol)",
         "sw AS (SELECT i AS symbol, sum(c * w) AS sw FROM cv JOIN ws ON ws.symbol = j GROUP BY i)",
         "pv AS (SELECT sqrt(sum(w * sw)) AS vol FROM sw JOIN ws USING (symbol))",
         "rc AS (SELECT symbol, w AS weight, sw / vol AS mrc, w * sw / vol AS crc, w * sw / vol / vol AS crc_pct, vol FROM sw JOIN ws USING (symbol), pv)")


def _risk(spark, sf_dir):
    bars = cut(bars_market(spark, sf_dir))
    rets = cut(panel_returns(panel(bars)))
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    w = attach(n, n.agg(F.sum("_n").alias("_t"))).select("symbol", (F.col("_n") / F.col("_t")).alias("weight"))
    return rets, cut(w), cut(pf.risk_contributions(rets, w))


def _q_risk(key: str, sql: str, cols: list[str]):
    @query(key, with_(MARKET, PANEL, _PANEL_RET, *_RISK) + sql)
    def run(spark, sf_dir):
        return rounded(_risk(spark, sf_dir)[2].select(*cols))


_q_risk("d20_marginal_risk", f"SELECT symbol, {r('mrc')} FROM rc", ["symbol", "mrc"])
_q_risk("d21_component_risk", f"SELECT symbol, {r('crc')}, {r('crc_pct')} FROM rc", ["symbol", "crc", "crc_pct"])


@query("d19_portfolio_volatility", with_(MARKET, PANEL, _PANEL_RET, *_RISK) + f"SELECT {r('vol', 'portfolio_volatility')} FROM pv")
def d19(spark, sf_dir):
    return rounded(_risk(spark, sf_dir)[2].agg(F.max("portfolio_volatility").alias("portfolio_volatility")))


@query("d22_risk_concentration", with_(MARKET, PANEL, _PANEL_RET, *_RISK) + f"SELECT {r('sum(pow(crc_pct / s, 2))', 'risk_concentration')} FROM rc, (SELECT sum(crc_pct) AS s FROM rc)")
def d22(spark, sf_dir):
    return rounded(pf.concentration(_risk(spark, sf_dir)[2]))


_TARGET = [("SPY", 0.5), ("TLT", 0.3), ("CASHLIKE", 0.2)]


@query("d23_risk_budget", with_(MARKET, PANEL, _PANEL_RET, *_RISK, "tg(symbol, target) AS (" + dims.values(_TARGET) + ")") +
       f"SELECT symbol, {r('coalesce(crc_pct, 0) - coalesce(target, 0)', 'deviation')} FROM rc FULL JOIN tg USING (symbol)")
def d23(spark, sf_dir):
    target = dims.frame(spark, _TARGET, "symbol string, target double")
    return rounded(pf.risk_budget(_risk(spark, sf_dir)[2], target))


@query("d24_full_decomposition", with_(MARKET, PANEL, _PANEL_RET, *_RISK,
       "po AS (SELECT d, sum(w * coalesce(ret, 0)) AS ret FROM pr JOIN ws USING (symbol) GROUP BY d)",
       "pe AS (SELECT d, ret, product(1 + ret) OVER (ORDER BY d) AS eq FROM po)", "pd AS (SELECT *, eq / max(eq) OVER (ORDER BY d) - 1 AS dd FROM pe)",
       "qv AS (SELECT quantile_cont(ret, 0.05) AS a, quantile_cont(ret, 0.01) AS b, quantile_cont(ret, 0.95) AS c FROM pd)") + f"""SELECT {r('(SELECT vol FROM pv)', 'portfolio_volatility')},
  {r('-max(a)', 'var_95')}, {r('-max(b)', 'var_99')}, {r('-avg(ret) FILTER (ret <= a)', 'cvar_95')}, {r('-avg(ret) FILTER (ret <= b)', 'cvar_99')},
  {r('sqrt(avg(dd * 100 * dd * 100))', 'ulcer_index')}, {r('max(c) / abs(max(a))', 'tail_ratio')}, {r('skewness(ret)', 'skew')}, {r('kurtosis(ret)', 'kurtosis')},
  {r('(SELECT sum(pow(crc_pct, 2)) / pow(sum(crc_pct), 2) FROM rc)', 'risk_concentration')} FROM pd, qv""")
def d24(spark, sf_dir):
    rets, w, contributions = _risk(spark, sf_dir)
    day = rets.join(w, "symbol").groupBy("d", "ts").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))
    day = cut(day.withColumn("series_id", F.lit("portfolio")))
    from barloom.operators.backtest import equity_curve
    ulcer = perf.ulcer_index(cut(equity_curve(day)))
    out = perf.tail_metrics(day).join(ulcer, "series_id").drop("series_id")
    vol = contributions.agg(F.max("portfolio_volatility").alias("portfolio_volatility"))
    return rounded(attach(attach(out, vol), pf.concentration(contributions)))


_ALLOC = ("ra(regime_id, symbol, alloc_pct) AS (" + dims.values(dims.REGIME_ALLOCATION) + ")", "vo(symbol, vol_pct) AS (" + dims.values(dims.ANNUAL_VOL_PCT) + ")",
          "px AS (SELECT symbol, max_by(close, ts) AS price FROM bars GROUP BY symbol)")


@query("p6_regime_lots", with_(MARKET, *_ALLOC) + f"""SELECT regime_id, symbol, alloc_pct, {r('100000 * alloc_pct / 100 * 0.2 / (coalesce(vol_pct, 20) / 100)', 'dollar_exposure', 4)},
  {r("100000 * alloc_pct / 100 * 0.2 / (coalesce(vol_pct, 20) / 100) / (coalesce(price, 100) * CASE WHEN symbol LIKE '%MES%' THEN 5 ELSE 1 END)", 'lots', 4)}
  FROM ra LEFT JOIN vo USING (symbol) LEFT JOIN px USING (symbol)""")
def p6(spark, sf_dir):
    prices = bars_market(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    alloc = dims.frame(spark, dims.REGIME_ALLOCATION, "regime_id int, symbol string, alloc_pct int")
    vols = dims.frame(spark, dims.ANNUAL_VOL_PCT, "symbol string, vol_pct double")
    df = pf.lots_for_regime(alloc, prices, vols, 100000.0, 0.2, dims.DEFAULT_VOL_PCT, dims.FUTURES_MULTIPLIER)
    return rounded(df.select("regime_id", "symbol", "alloc_pct", "dollar_exposure", "lots"), 4)


# ---------------------------------------------------------------------- factors

_PROX = ("fp(factor, prio, long, short) AS (" + dims.values(dims.FACTOR_PROXIES) + ")", "av AS (SELECT DISTINCT symbol FROM bars)",
         """ok AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY prio) AS k FROM fp WHERE long IN (SELECT symbol FROM av)
  AND (short = '' OR short IN (SELECT symbol FROM av)))""", "px AS (SELECT * FROM ok WHERE k = 1)")
_FRET = ("fj AS (SELECT factor, a.ts, a.close AS l, b.close AS s FROM px JOIN bars a ON a.symbol = long LEFT JOIN bars b ON b.symbol = short AND b.ts = a.ts WHERE short = '' OR b.close IS NOT NULL)",
         "fr0 AS (SELECT factor, ts, coalesce(l / lag(l) OVER w - coalesce(s / lag(s) OVER w, 1), 0) AS ret FROM fj WINDOW w AS (PARTITION BY factor ORDER BY ts))",
         "fall(factor) AS (" + dims.values([(f,) for f in dims.FACTORS]) + ")",
         """fr AS (SELECT * FROM fr0 UNION ALL SELECT factor, ts, 0.0 FROM fall CROSS JOIN (SELECT ts FROM bars WHERE symbol = (SELECT min(symbol) FROM bars))
  WHERE factor NOT IN (SELECT factor FROM px))""")


@query("c12_first_available", with_(MARKET, *_PROX) + "SELECT factor, CAST(prio AS INT) AS prio, long, short FROM px")
def c12(spark, sf_dir):
    return fac.chosen_proxies(bars_market(spark, sf_dir).select("symbol")).select("factor", "prio", "long", "short")


@query("e27_factor_returns", with_(MARKET, *_PROX, *_FRET) + f"SELECT ts, factor, {r('ret')} FROM fr")
def e27(spark, sf_dir):
    return rounded(fac.factor_returns(bars_market(spark, sf_dir)))


_SCORE = "hs(symbol, factor, score) AS (" + dims.values(dims.factor_score_rows()) + ")"
_HOLD = ("vw AS (SELECT ts, symbol, sqrt(volume) / sum(sqrt(volume)) OVER (PARTITION BY ts) AS weight FROM bars)",
         "sx AS (SELECT ts, factor, sum(weight * score) AS x FROM vw JOIN hs USING (symbol) GROUP BY ts, factor)",
         "fall2(factor) AS (" + dims.values([(f,) for f in dims.FACTORS]) + ")",
         "he AS (SELECT t.ts, f.factor, round(coalesce(x, 0) / t.w, 7) + 0.0 AS exposure FROM (SELECT ts, sum(weight) AS w FROM vw GROUP BY ts) t CROSS JOIN fall2 f LEFT JOIN sx ON sx.ts = t.ts AND sx.factor = f.factor)")


def _holdings(spark, sf_dir):
    bars = cut(bars_market(spark, sf_dir).select("ts", "symbol", F.sqrt("volume").alias("volume")))
    total = bars.groupBy("ts").agg(F.sum("volume").alias("_t"))
    w = bars.join(total, "ts").select("ts", "symbol", (F.col("volume") / F.col("_t")).alias("weight"))
    return fac.holdings_exposure(w, fac.default_scores(spark), digits=7)


@query("e28_holdings_exposure", with_(MARKET, _SCORE, *_HOLD) + "SELECT ts, factor, exposure FROM he")
def e28(spark, sf_dir):
    return _holdings(spark, sf_dir)


@query("d33_monthly_exposure", with_(MARKET, _SCORE, *_HOLD) + f"SELECT factor, CAST(date_trunc('month', ts) AS DATE) AS month, {r('avg(exposure)', 'exposure')} FROM he GROUP BY factor, date_trunc('month', ts)")
def d33(spark, sf_dir):
    return rounded(fac.monthly_exposure(_holdings(spark, sf_dir)))


_FBY = "PARTITION BY factor ORDER BY ts"


@query("e29_returns_exposure", with_(MARKET, RET, *_PROX, *_FRET, "po AS (SELECT ts, avg(ret) AS pr FROM rr WHERE ret IS NOT NULL GROUP BY ts)",
       "jj AS (SELECT factor, ts, ret, pr FROM fr JOIN po USING (ts))") + f"""SELECT factor, ts,
  {r(f"({roll('covar_samp(pr, ret)', 'ret', 60, _FBY)}) / nullif({roll('var_samp(ret)', 'ret', 60, _FBY)}, 0)", 'exposure', 5)} FROM jj""")
def e29(spark, sf_dir):
    bars = market(spark, sf_dir)
    port = feat.returns(bars).where(F.col("ret").isNotNull()).groupBy("ts").agg(F.avg("ret").alias("ret"))
    return rounded(fac.returns_exposure(port, fac.factor_returns(bars)), 5)
