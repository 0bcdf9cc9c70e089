"""Feature queries: one per windowed or cross-sectional feature."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from barloom.functions.scalars import crossed_down, crossed_up, rounded
from barloom.operators import backtest as bt, features as feat
from barloom.operators.timeline import pick, scan
from barloom.plans.catalog import query
from barloom.plans.sqltext import BRAND, BY, FLAG, HOUR, MARKET, ema, r, roll, with_
from barloom.plans.inputs import brand, flag, hour, market
from barloom.session import cut
from barloom.sources.derived import bars_brand, bars_flag, bars_market

RET = "ret AS (SELECT symbol, ts, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars)"


def _feature(name: str, f: feat.Feature, expr: str, *ctes: str, src: str = "bars", extra: str = "", digits: int = 6):
    """Register ``name``: one feature over the brand bars against one SQL expression."""
    col = name.split("_", 1)[1]
    sql = with_(BRAND, *ctes) + f"SELECT symbol, ts, {r(expr, col, digits)} FROM {src} {extra}"

    @query(name, sql)
    def run(spark, sf_dir):
        df = feat.compute(brand(spark, sf_dir), {col: f})
        return rounded(df.select("symbol", "ts", col), digits)
    return run


_feature("e4_momentum", feat.momentum(252), f"close / lag(close, 252) OVER ({BY}) - 1")
_feature("e6_rolling_cagr", feat.rolling_cagr(126), f"pow(close / lag(close, 126) OVER ({BY}), 2.0) - 1")
_feature("e7_rolling_volatility", feat.rolling_volatility(20), f"({roll('stddev_samp(ret)', 'ret', 20)}) * sqrt(252.0)",
         RET, src="ret")
_feature("e13_sma", feat.sma(50), roll("avg(close)", "close", 50), digits=8)
_feature("e16_z_score", feat.z_score(20),
         f"(close - ({roll('avg(close)', 'close', 20)})) / nullif({roll('stddev_samp(close)', 'close', 20)}, 0)", digits=5)
_feature("e17_rolling_sharpe", feat.rolling_sharpe(60),
         f"({roll('avg(ret)', 'ret', 60)}) / nullif({roll('stddev_samp(ret)', 'ret', 60)}, 0) * sqrt(252.0)",
         RET, src="ret")
_DOWN = "CASE WHEN ret < 0 THEN ret END"
_W60 = f"OVER ({BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_feature("e18_rolling_sortino", feat.rolling_sortino(60),
         f"CASE WHEN count(ret) {_W60} = 60 THEN avg(ret) {_W60} / nullif(CASE WHEN count({_DOWN}) {_W60} > 1 "
         f"THEN stddev_samp({_DOWN}) {_W60} ELSE stddev_samp(ret) {_W60} END, 0) * sqrt(252.0) END", RET, src="ret")

_RSI = f"""d AS (SELECT symbol, ts, close - lag(close) OVER ({BY}) AS d FROM bars),
g AS (SELECT symbol, ts, CASE WHEN d > 0 THEN d ELSE 0.0 END AS up, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS dn FROM d),
m AS (SELECT symbol, ts, {roll('avg(up)', 'up', 14)} AS up, {roll('avg(dn)', 'dn', 14)} AS dn FROM g)"""
_feature("e5_rsi", feat.rsi(14), "coalesce(100 - 100 / (1 + up / nullif(dn, 0)), 50)", _RSI, src="m")

_LISTS = f"""lists AS (SELECT symbol, ts, close, lag(close, 252) OVER ({BY}) AS c252,
  list(close) OVER ({BY} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS l FROM bars),
mdd AS (SELECT symbol, ts, close, c252, l, CASE WHEN len(l) = 252 THEN
  list_min(list_transform(range(1, 253), lambda k: l[k] / list_max(l[1:k]) - 1)) END AS mdd FROM lists)"""
_MDD = f"""num AS (SELECT symbol, ts, close, row_number() OVER ({BY}) AS i FROM bars),
pk AS (SELECT e.symbol, e.ts, s.i, e.i AS e, s.close, max(s.close) OVER (PARTITION BY e.symbol, e.i ORDER BY s.i) AS peak
  FROM num e JOIN num s ON s.symbol = e.symbol AND s.i BETWEEN e.i - 251 AND e.i WHERE e.i >= 252),
worst AS (SELECT symbol, ts, min(close / peak - 1) AS mdd FROM pk GROUP BY symbol, ts),
mdd AS (SELECT b.symbol, b.ts, b.close / lag(b.close, 252) OVER (PARTITION BY b.symbol ORDER BY b.ts) - 1 AS cagr, w.mdd
  FROM bars b LEFT JOIN worst w USING (symbol, ts))"""
_feature("e10_rolling_max_drawdown", feat.rolling_max_drawdown(252), "mdd", _MDD, src="mdd")
_feature("e19_rolling_calmar", feat.rolling_calmar(252), "cagr / nullif(abs(mdd), 0)", _MDD, src="mdd")

_TR = f"""tr AS (SELECT symbol, ts, greatest(high - low, abs(high - lag(close) OVER ({BY})), abs(low - lag(close) OVER ({BY}))) AS tr,
  high - lag(high) OVER ({BY}) AS up, lag(low) OVER ({BY}) - low AS dn FROM bars)"""
_feature("e11_atr", feat.atr(14), roll("avg(tr)", "tr", 14), _TR, src="tr", digits=8)
_ADX = f"""dm AS (SELECT symbol, ts, tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS p,
  CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS m FROM tr),
di AS (SELECT symbol, ts, 100 * ({roll('avg(p)', 'p', 14)}) / nullif({roll('avg(tr)', 'tr', 14)}, 0) AS pdi,
  100 * ({roll('avg(m)', 'm', 14)}) / nullif({roll('avg(tr)', 'tr', 14)}, 0) AS mdi FROM dm),
dx AS (SELECT symbol, ts, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM di)"""
_feature("e12_adx", feat.adx(14), roll("avg(dx)", "dx", 14), _TR, _ADX, src="dx")

_RANKW = f"""num AS (SELECT symbol, ts, close, row_number() OVER ({BY}) AS i FROM bars),
cnt AS (SELECT e.symbol, e.ts, sum(CASE WHEN s.close < e.close THEN 1 ELSE 0 END) AS less,
  sum(CASE WHEN s.close = e.close THEN 1 ELSE 0 END) AS eq
  FROM num e JOIN num s ON s.symbol = e.symbol AND s.i BETWEEN e.i - 251 AND e.i WHERE e.i >= 252 GROUP BY e.symbol, e.ts),
pr AS (SELECT b.symbol, b.ts, (less + (eq + 1) / 2.0) / 252.0 * 100 AS pr FROM bars b LEFT JOIN cnt USING (symbol, ts))"""
_feature("e20_percentile_rank", feat.percentile_rank(252), "pr", _RANKW, src="pr")



def trend_slope(x: np.ndarray, n: int) -> np.ndarray:
    """Least-squares slope per bar over the last ``n`` values, as an example of a function of the user's own."""
    at = np.arange(n) - (n - 1) / 2
    return np.convolve(x, (at / (at * at).sum())[::-1])[:len(x)]


_W20 = f"OVER ({BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_feature("j4_rolling_user_function", feat.rolling_apply(20, trend_slope), f"CASE WHEN count(close) {_W20} = 20 THEN regr_slope(close, i) {_W20} END",
         f"num AS (SELECT symbol, ts, close, row_number() OVER ({BY}) AS i FROM bars)", src="num", digits=9)

_OVN = f"""onr AS (SELECT symbol, ts, open / lag(close) OVER ({BY}) - 1 AS overnight, close / open - 1 AS intraday FROM bars),
df AS (SELECT *, overnight - intraday AS diff FROM onr)"""


@query("e26_overnight_intraday", with_(BRAND, _OVN) +
       f"SELECT symbol, ts, {r('overnight')}, {r('intraday')}, {r(roll('avg(diff)', 'diff', 504), 'score')} FROM df")
def e26(spark, sf_dir):
    df = feat.compute(brand(spark, sf_dir), {"score": feat.overnight_score(504)}, keep_index=True)
    return rounded(df.select("symbol", "ts", (F.col("open") / F.col("_pc") - 1).alias("overnight"),
                             (F.col("close") / F.col("open") - 1).alias("intraday"), "score"))


@query("e1_drawdown", with_(BRAND) +
       f"SELECT symbol, ts, {r(f'close / max(close) OVER ({BY}) - 1', 'drawdown')} FROM bars")
def e1(spark, sf_dir):
    from barloom.operators.performance import drawdown
    df = drawdown(brand(spark, sf_dir), ("symbol",), "close")
    return rounded(df.select("symbol", "ts", "drawdown"))


@query("e2_equity_curve", with_(BRAND, RET) +
       f"SELECT symbol, ts, {r(f'100000 * product(1 + coalesce(ret, 0)) OVER ({BY})', 'equity', 4)} FROM ret")
def e2(spark, sf_dir):
    rets = feat.returns(brand(spark, sf_dir))
    return rounded(bt.equity_curve(rets, ("symbol",), capital=100000.0).select("symbol", "ts", "equity"), 4)


@query("e3_drawdown_duration", with_(BRAND, f"""dd AS (SELECT symbol, ts, row_number() OVER ({BY}) AS rn,
  close / max(close) OVER ({BY}) - 1 AS dd FROM bars)""") +
       f"SELECT symbol, ts, rn - coalesce(last_value(CASE WHEN dd = 0 THEN rn END IGNORE NULLS) OVER ({BY}), 0) AS duration FROM dd")
def e3(spark, sf_dir):
    from barloom.operators.performance import drawdown_duration
    df = drawdown_duration(brand(spark, sf_dir), ("symbol",), "close")
    return df.select("symbol", "ts", "duration")


_BENCH = f"""j AS (SELECT a.symbol, a.ts, a.close, a.ret, b.close AS bench_close, b.ret AS bench_ret
  FROM ret a JOIN ret b ON a.ts = b.ts AND b.symbol = 'SPY')"""
_PAIR = "CASE WHEN ret IS NOT NULL AND bench_ret IS NOT NULL THEN 1 END"


@query("e8_rolling_beta", with_(MARKET, RET, _BENCH) + f"""SELECT symbol, ts, {r(
    f"({roll('covar_samp(ret, bench_ret)', _PAIR, 60)}) / nullif({roll('var_samp(bench_ret)', 'bench_ret', 60)}, 0)", 'rolling_beta')} FROM j""")
def e8(spark, sf_dir):
    df = feat.rolling_benchmark(market(spark, sf_dir), "SPY", 60)
    return rounded(df.select("symbol", "ts", "rolling_beta"))


@query("e9_rolling_correlation", with_(MARKET, RET, _BENCH) +
       f"SELECT symbol, ts, {r(roll('corr(ret, bench_ret)', _PAIR, 60), 'rolling_corr')} FROM j")
def e9(spark, sf_dir):
    df = feat.rolling_benchmark(market(spark, sf_dir), "SPY", 60)
    return rounded(df.select("symbol", "ts", "rolling_corr"))


@query("e15_relative_strength", with_(MARKET) + f"""SELECT a.symbol, a.ts, {r('a.close / nullif(b.close, 0)', 'rs')}
  FROM bars a JOIN bars b ON a.ts = b.ts AND b.symbol = 'XLK'""")
def e15(spark, sf_dir):
    return rounded(feat.relative_strength(bars_market(spark, sf_dir), "XLK"))


@query("e14_golden_death_cross", with_(BRAND, f"""ma AS (SELECT symbol, ts, {roll('avg(close)', 'close', 50)} AS f,
  {roll('avg(close)', 'close', 200)} AS s FROM bars),
lg AS (SELECT *, lag(f) OVER ({BY}) AS fp, lag(s) OVER ({BY}) AS sp FROM ma)""") + """SELECT symbol, ts,
  coalesce(f > s AND fp <= sp, false) AS golden_cross, coalesce(f < s AND fp >= sp, false) AS death_cross FROM lg""")
def e14(spark, sf_dir):
    df = feat.compute(brand(spark, sf_dir), {
        "golden_cross": feat.golden_cross(50, 200), "death_cross": feat.death_cross(50, 200)})
    return df.select("symbol", "ts", "golden_cross", "death_cross")


@query("e13_ema", with_(BRAND, ema("e", "bars", {"ema_5": ("close", 5), "ema_50": ("close", 50), "ema_222": ("close", 222)}),
                        recursive=True) +
       f"SELECT symbol, ts, {r('ema_5', digits=4)}, {r('ema_50', digits=4)}, {r('ema_222', digits=4)} FROM e")
def e13(spark, sf_dir):
    return rounded(feat.ema(pick(brand(spark, sf_dir), "close"),
                            {"ema_5": 5, "ema_50": 50, "ema_222": 222}).drop("close"), 4)


@query("e21_cross_sectional_rank", with_(BRAND, f"mom AS (SELECT symbol, ts, close / lag(close, 20) OVER ({BY}) - 1 AS m FROM bars)",
       """rk AS (SELECT symbol, ts, (rank() OVER (PARTITION BY ts ORDER BY m) +
  (count(*) OVER (PARTITION BY ts, m) - 1) / 2.0) / count(*) OVER (PARTITION BY ts) * 100 AS cs_rank FROM mom WHERE m IS NOT NULL)""") +
       f"SELECT symbol, ts, {r('cs_rank')} FROM mom LEFT JOIN rk USING (symbol, ts)")
def e21(spark, sf_dir):
    df = feat.compute(brand(spark, sf_dir), {"m": feat.momentum(20)})
    return rounded(feat.cross_sectional_rank(df, "m").select("symbol", "ts", "cs_rank"))


@query("e22_feature_set", with_(FLAG, RET) + f"""SELECT symbol, ts, {r(f'close / lag(close, 20) OVER ({BY}) - 1', 'momentum_20', 8)},
  {r(roll('avg(close)', 'close', 20), 'sma_20', 8)}, {r(f"({roll('stddev_samp(ret)', 'ret', 20)}) * sqrt(252.0)", 'vol_20', 8)} FROM ret""")
def e22(spark, sf_dir):
    bars = flag(spark, sf_dir)
    wanted = {"momentum_20": ("momentum", 20), "sma_20": ("sma", 20), "vol_20": ("rolling_volatility", 20)}
    df = feat.compute(bars, {n: feat.feature(f, k) for n, (f, k) in wanted.items()})
    return rounded(df.select("symbol", "ts", *wanted), 8)


@query("e23_donchian", with_(BRAND, f"""c AS (SELECT symbol, ts,
  CASE WHEN count(high) OVER u = 20 THEN max(high) OVER u END AS don_upper,
  CASE WHEN count(low) OVER l = 10 THEN min(low) OVER l END AS don_lower FROM bars
  WINDOW u AS ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), l AS ({BY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))""") +
       f"SELECT symbol, ts, {r('don_upper')}, {r('don_lower')} FROM c")
def e23(spark, sf_dir):
    df = feat.compute(brand(spark, sf_dir), {"don": feat.donchian(20, 10)})
    return rounded(df.select("symbol", "ts", "don_upper", "don_lower"))


EWMAC_CTES = (
    f"chg AS (SELECT symbol, ts, close, close - lag(close) OVER ({BY}) AS d, row_number() OVER ({BY}) - 1 AS i FROM bars)",
    """rec AS (SELECT symbol, ts, i, close, close AS ef, close AS es, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v, 0.0::DOUBLE AS x, 0.0::DOUBLE AS q
  FROM chg WHERE i = 0 UNION ALL
  SELECT n.symbol, n.ts, n.i, n.close, 2.0/33*n.close + 31.0/33*p.ef, 2.0/129*n.close + 127.0/129*p.es,
    1 + p.w*24.0/26, 1 + p.v*(24.0/26)*(24.0/26), n.d + p.x*24.0/26, n.d*n.d + p.q*24.0/26
  FROM rec p JOIN chg n ON n.symbol = p.symbol AND n.i = p.i + 1)""",
    """raw AS (SELECT symbol, ts, close, i, (ef - es) /
  nullif(CASE WHEN i > 1 THEN sqrt(greatest((w*q - x*x) / nullif(w*w - v, 0), 0)) END, 0) AS f FROM rec),
fc AS (SELECT symbol, ts, close, i, coalesce(CASE WHEN f > 20 THEN 20 WHEN f < -20 THEN -20 ELSE f END, 0) AS forecast FROM raw)""")


@query("e24_ewmac_forecast", with_(BRAND, *EWMAC_CTES, recursive=True) + f"SELECT symbol, ts, {r('forecast', digits=4)} FROM fc")
def e24(spark, sf_dir):
    df = feat.ewmac(brand(spark, sf_dir))
    return rounded(df.select("symbol", "ts", "forecast"), 4)


@query("e30_month_end", with_(BRAND) + f"""SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS period, max(ts) AS ts,
  {r('max_by(close, ts)', 'close')} FROM bars GROUP BY symbol, date_trunc('month', ts)""")
def e30(spark, sf_dir):
    return rounded(feat.resample_last(bars_brand(spark, sf_dir)))


@query("b1_crossover", with_(FLAG, f"""l AS (SELECT symbol, ts, close, open, lag(close) OVER ({BY}) AS cp, lag(open) OVER ({BY}) AS op FROM bars)""") +
       """SELECT symbol, ts, coalesce(close > open AND cp <= op, false) AS up, coalesce(close < open AND cp >= op, false) AS down,
  coalesce(close > 105 AND cp <= 105, false) AS level_up FROM l""")
def b1(spark, sf_dir):
    df = scan(cut(bars_flag(spark, sf_dir)), {"cp": ("prev", F.col("close")), "op": ("prev", F.col("open"))})
    c, o, cp, op, level = F.col("close"), F.col("open"), F.col("cp"), F.col("op"), F.lit(105.0)
    return df.select("symbol", "ts", crossed_up(c, o, cp, op).alias("up"), crossed_down(c, o, cp, op).alias("down"),
                     crossed_up(c, level, cp, level).alias("level_up"))


@query("e16_hourly_z_score", with_(HOUR) + f"""SELECT symbol, strftime(ts, '%Y-%m-%d %H') AS hour, {r(
    f"(close - ({roll('avg(close)', 'close', 24)})) / nullif({roll('stddev_samp(close)', 'close', 24)}, 0)", 'z')} FROM bars""")
def e16_hour(spark, sf_dir):
    df = feat.compute(hour(spark, sf_dir), {"z": feat.z_score(24)})
    return rounded(df.select("symbol", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "z"))
