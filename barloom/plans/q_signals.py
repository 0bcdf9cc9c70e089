"""Signals, screener, positions and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import rounded
from barloom.operators import backtest as bt, features as feat, signals as sig
from barloom.plans.catalog import query
from barloom.plans.q_features import EWMAC_CTES
from barloom.plans.sqltext import BRAND, BY, FLAG, MARKET, ema, r, roll, with_
from barloom.session import cut
from barloom.plans.inputs import brand, flag
from barloom.sources.derived import bars_brand, bars_market


def temacd_sql(p: sig.TripleEma = sig.DEFAULT, warmup: bool = True, src: str = "bars") -> tuple[str, ...]:
    """CTEs up to ``cond``: crossings and long/short per bar."""
    start = max(p.macd_fast, p.macd_slow) - 1 if warmup else 0
    shown = start + (p.macd_signal - 1 if warmup else 0)

    def mask(col, span):
        return f"CASE WHEN i >= {span - 1 if warmup else 0} THEN {col} END AS {col}"
    return (
        ema("e", src, {"ema1": ("close", p.fast), "ema2": ("close", p.mid), "ema3": ("close", p.slow),
                       "mf": ("close", p.macd_fast), "ms": ("close", p.macd_slow)}, keep="close"),
        "m AS (SELECT symbol, ts, i, close, ema1, ema2, ema3, mf - ms AS macd FROM e)",
        ema("a", "m", {"amacd": ("macd", p.macd_signal)}, start=start),
        f"""t AS (SELECT m.symbol, m.ts, m.i, m.close, {mask('ema1', p.fast).replace('i >=', 'm.i >=')},
  {mask('ema2', p.mid).replace('i >=', 'm.i >=')}, {mask('ema3', p.slow).replace('i >=', 'm.i >=')},
  CASE WHEN m.i >= {start} THEN macd END AS macd, CASE WHEN m.i >= {shown} THEN amacd END AS amacd
  FROM m AS m LEFT JOIN a AS a USING (symbol, ts))""",
        "td AS (SELECT *, macd - amacd AS delta FROM t)",
        f"""lg AS (SELECT *, lag(delta) OVER w AS dp, lag(ema1) OVER w AS p1, lag(ema2) OVER w AS p2, lag(ema3) OVER w AS p3,
  lag(close) OVER w AS prev_close FROM td WINDOW w AS ({BY}))""",
        """x AS (SELECT *, coalesce(delta > 0 AND dp <= 0, false) AS delta_up, coalesce(delta < 0 AND dp >= 0, false) AS delta_down,
  coalesce(ema1 > ema2 AND p1 <= p2, false) AS e12_up, coalesce(ema1 < ema2 AND p1 >= p2, false) AS e12_down,
  coalesce(ema1 > ema3 AND p1 <= p3, false) AS e13_up, coalesce(ema1 < ema3 AND p1 >= p3, false) AS e13_down,
  coalesce(ema2 > ema3 AND p2 <= p3, false) AS e23_up, coalesce(ema2 < ema3 AND p2 >= p3, false) AS e23_down FROM lg)""",
        """cond AS (SELECT *, delta_up OR e12_up OR e13_up OR e23_up AS long,
  delta_down OR e12_down OR e13_down OR e23_down AS short FROM x)""",
    )


TRIG = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in sig.TRIGGERS) + "], lambda v: v IS NOT NULL)"
TREND = """CASE WHEN ema1 > ema2 AND ema2 > ema3 THEN 'STRONG BULL' WHEN ema1 > ema2 THEN 'BULLISH'
    WHEN ema1 < ema2 AND ema2 < ema3 THEN 'STRONG BEAR' WHEN ema1 < ema2 THEN 'BEARISH' ELSE 'NEUTRAL/ROTATION' END"""
SCREEN = temacd_sql() + (
    f"""lastbar AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM cond)""",
    f"""screen AS (SELECT symbol, ts AS date, close, prev_close, (close - prev_close) / prev_close * 100 AS chg_pct,
  ema1, ema2, ema3, delta, macd, amacd, long, short,
  CASE WHEN long THEN 'LONG ENTRY' WHEN short THEN 'SHORT/EXIT' ELSE 'HOLD' END AS signal,
  {TREND} AS trend,
  CASE WHEN len({TRIG}) > 0 THEN {TRIG} ELSE ['-'] END AS triggers
  FROM lastbar WHERE back = 1 AND i >= 249 AND ema3 IS NOT NULL AND delta IS NOT NULL)""")

_SCREEN_COLS = f"""symbol, date, {r('close', digits=4)}, {r('prev_close', digits=4)}, {r('chg_pct', digits=4)}, {r('ema1', digits=4)},
  {r('ema2', digits=4)}, {r('ema3', digits=4)}, {r('delta', digits=4)}, {r('macd', digits=4)}, {r('amacd', digits=4)},
  long, short, signal, trend, triggers"""


def _text_triggers(df):
    return df.withColumn("triggers", F.array_join("triggers", "; "))


@query("i2_screener", with_(BRAND, *SCREEN, recursive=True) +
       f"SELECT {_SCREEN_COLS.replace('triggers', '''array_to_string(triggers, '; ') AS triggers''')} FROM screen")
def i2(spark, sf_dir):
    return _text_triggers(rounded(sig.screener(brand(spark, sf_dir)), 4))


@query("i2_screener_flag", with_(FLAG, *SCREEN, recursive=True) + "SELECT symbol, date, signal, trend FROM screen")
def i2_flag(spark, sf_dir):
    return sig.screener(flag(spark, sf_dir)).select("symbol", "date", "signal", "trend")


@query("e25_temacd", with_(BRAND, *temacd_sql(), recursive=True) + f"""SELECT symbol, ts, {r('ema1', digits=4)}, {r('ema2', digits=4)},
  {r('ema3', digits=4)}, {r('macd', digits=4)}, {r('amacd', digits=4)}, {r('delta', digits=4)} FROM td""")
def e25(spark, sf_dir):
    return rounded(sig.temacd(brand(spark, sf_dir)).drop("close"), 4)


@query("e25_temacd_no_warmup", with_(BRAND, *temacd_sql(warmup=False), recursive=True) +
       f"SELECT symbol, ts, {r('macd', digits=4)}, {r('amacd', digits=4)} FROM td")
def e25b(spark, sf_dir):
    return rounded(sig.temacd(brand(spark, sf_dir), warmup=False).select("symbol", "ts", "macd", "amacd"), 4)


def _signal_sql(first: str) -> str:
    a, b = ("long", "short") if first == "long" else ("short", "long")
    v = {"long": 1, "short": -1}
    return (f"sg AS (SELECT symbol, ts, CASE WHEN {a} THEN {v[a]} WHEN {b} THEN {v[b]} ELSE 0 END AS signal FROM cond) ")


@query("i1_temacd_signal", with_(BRAND, *temacd_sql(warmup=False), _signal_sql("short"), recursive=True) +
       "SELECT symbol, ts, signal, CASE WHEN signal <> 0 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM sg")
def i1(spark, sf_dir):
    conds = sig.temacd_conditions(brand(spark, sf_dir), warmup=False)
    return sig.signal_table(conds).select("symbol", "ts", "signal", "confidence")


@query("i1_long_precedence", with_(BRAND, *temacd_sql(), _signal_sql("long"), recursive=True) + "SELECT symbol, ts, signal FROM sg")
def i1b(spark, sf_dir):
    conds = sig.temacd_conditions(brand(spark, sf_dir))
    return sig.signal_table(conds, "long").select("symbol", "ts", "signal")


@query("i3_btc_preset", with_(BRAND, *temacd_sql(sig.BITCOIN), recursive=True) + "SELECT symbol, ts, long, short FROM cond")
def i3(spark, sf_dir):
    return sig.temacd_conditions(brand(spark, sf_dir), sig.BITCOIN).select("symbol", "ts", "long", "short")


def _pair_cte(f: int, s: int) -> tuple[str, ...]:
    return (ema("e", "bars", {"f0": ("close", f), "s0": ("close", s)}, keep="close"),
            f"ma AS (SELECT symbol, ts, close, CASE WHEN i >= {f - 1} THEN f0 END AS f, CASE WHEN i >= {s - 1} THEN s0 END AS s FROM e)",
            f"lg AS (SELECT *, lag(f) OVER ({BY}) AS fp, lag(s) OVER ({BY}) AS sp FROM ma)",
            """ud AS (SELECT *, coalesce(f > s AND fp <= sp, false) AS up, coalesce(f < s AND fp >= sp, false) AS down FROM lg)""")


MA_CROSS = _pair_cte(50, 200) + (
    "cond AS (SELECT symbol, ts, close, up AND close > s AS long, down OR coalesce(close < s, false) AS short FROM ud)",)
EMA_CROSS = _pair_cte(10, 40) + ("cond AS (SELECT symbol, ts, close, up AS long, down AS short FROM ud)",)
DON_TREND = (
    ema("e", "bars", {"f0": ("close", 32), "s0": ("close", 128)}, keep="close,high,low"),
    f"""ch AS (SELECT symbol, ts, close, CASE WHEN i >= 31 THEN f0 END AS f, CASE WHEN i >= 127 THEN s0 END AS s,
  CASE WHEN i >= 20 THEN max(high) OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS up,
  CASE WHEN i >= 10 THEN min(low) OVER ({BY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS dn FROM e)""",
    """cond AS (SELECT symbol, ts, close, coalesce(close > up AND f > s, false) AS long,
  coalesce(close < dn, false) OR coalesce(f < s, false) AS short FROM ch)""")


@query("i4_ma_cross", with_(BRAND, *MA_CROSS, recursive=True) + "SELECT symbol, ts, long, short FROM cond")
def i4(spark, sf_dir):
    return sig.ma_cross(brand(spark, sf_dir)).select("symbol", "ts", "long", "short")


@query("i5_donchian_trend", with_(BRAND, *DON_TREND, recursive=True) + "SELECT symbol, ts, long, short FROM cond")
def i5(spark, sf_dir):
    return sig.donchian_trend(brand(spark, sf_dir)).select("symbol", "ts", "long", "short")


@query("i6_ema_cross", with_(BRAND, *EMA_CROSS, recursive=True) + "SELECT symbol, ts, long, short FROM cond")
def i6(spark, sf_dir):
    return sig.ema_cross(brand(spark, sf_dir)).select("symbol", "ts", "long", "short")


def _renamed(ctes: tuple[str, ...], tag: str, names: str) -> tuple[str, ...]:
    """Give the CTE names of one signal a private suffix so several can be combined."""
    import re
    out = []
    for c in ctes:
        for n in sorted(names.split(), key=len, reverse=True):
            c = re.sub(rf"(?<![\w.]){n}(?= AS (MATERIALIZED )?\()|(?<=FROM ){n}\b|(?<=JOIN ){n}\b", f"{n}_{tag}", c)
        out.append(c)
    return tuple(out)


_TEMACD_NAMES = "e_n e m a_n a t td lg x cond"
# every registered signal: name, tag of its CTEs, CTEs, their names
SIGNAL_CTES = [
    ("BTC_TEMACD", "b", temacd_sql(sig.BITCOIN), _TEMACD_NAMES), ("DONCHIAN_CARVER", "d", DON_TREND, "e_n e ch cond"),
    ("EMA_CROSS_10_40", "k", EMA_CROSS, "e_n e ma lg ud cond"), ("LT_MA_CROSS", "l", MA_CROSS, "e_n e ma lg ud cond"),
    ("TQQQ_TEMACD", "q", temacd_sql(), _TEMACD_NAMES)]
_ALL_SIGNALS = (*[c for _, tag, ctes, names in SIGNAL_CTES for c in _renamed(ctes, tag, names)], "sigs AS (" + " UNION ALL ".join(
    f"SELECT symbol, ts, '{name}' AS strategy, CASE WHEN short THEN -1 WHEN long THEN 1 ELSE 0 END AS signal FROM cond_{tag}"
    for name, tag, _, _ in SIGNAL_CTES) + ")")


@query("i8_generate_all", with_(BRAND, *_ALL_SIGNALS, recursive=True) + "SELECT symbol, ts, strategy, signal FROM sigs")
def i8(spark, sf_dir):
    return sig.generate_all(brand(spark, sf_dir)).drop("confidence")


@query("i7_combined_signals", with_(BRAND, *_ALL_SIGNALS, """c AS (SELECT symbol, ts, sum((signal = 1)::INT) AS p, sum((signal = -1)::INT) AS n,
  count(*) AS k FROM sigs GROUP BY symbol, ts)""", recursive=True) + """SELECT symbol, ts, CASE WHEN p > 0 THEN 1 WHEN n > 0 THEN -1 ELSE 0 END AS any_of,
  CASE WHEN p = k THEN 1 WHEN n = k THEN -1 ELSE 0 END AS all_of, CASE WHEN p > n THEN 1 WHEN n > p THEN -1 ELSE 0 END AS majority FROM c""")
def i7(spark, sf_dir):
    every = cut(sig.generate_all(brand(spark, sf_dir)))
    ways = {"or": "any_of", "and": "all_of", "majority": "majority"}
    parts = [sig.combine(every, how).select("symbol", "ts", F.col("signal").alias(name)) for how, name in ways.items()]
    return parts[0].join(parts[1], ["symbol", "ts"]).join(parts[2], ["symbol", "ts"])


_POS9 = f"""pos AS (SELECT symbol, ts, close, coalesce(last_value(CASE WHEN long THEN 1 WHEN short THEN 0 END IGNORE NULLS)
  OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position FROM cond)"""


@query("i9_hold_position", with_(BRAND, *temacd_sql(), _POS9, recursive=True) + "SELECT symbol, ts, position FROM pos")
def i9(spark, sf_dir):
    conds = sig.temacd_conditions(brand(spark, sf_dir)).select("symbol", "ts", "close", "long", "short")
    return bt.hold_position(conds).select("symbol", "ts", "position")


def _machine(short_state: int) -> tuple[str, ...]:
    """The state machine as a recursion over row numbers: an independent formulation."""
    return (f"seq AS MATERIALIZED (SELECT symbol, ts, close, long, short, row_number() OVER ({BY}) AS i FROM cond)",
            f"""pos AS (SELECT symbol, ts, close, i, CASE WHEN long THEN 1 WHEN short THEN {short_state} ELSE 0 END AS position
  FROM seq WHERE i = 1 UNION ALL
  SELECT n.symbol, n.ts, n.close, n.i, CASE WHEN n.long AND p.position <= 0 THEN 1 WHEN n.short AND p.position >= 0 THEN {short_state}
  ELSE p.position END FROM pos p JOIN seq n ON n.symbol = p.symbol AND n.i = p.i + 1)""")


def _cond(bars):
    return sig.temacd_conditions(bars).select("symbol", "ts", "close", "long", "short")


@query("i10_state_position", with_(BRAND, *temacd_sql(), *_machine(0), recursive=True) + "SELECT symbol, ts, position FROM pos")
def i10(spark, sf_dir):
    return bt.state_position(_cond(brand(spark, sf_dir)), 0).select("symbol", "ts", "position")


@query("i10_long_short_position", with_(BRAND, *DON_TREND, *_machine(-1), recursive=True) + "SELECT symbol, ts, position FROM pos")
def i10b(spark, sf_dir):
    return bt.state_position(sig.donchian_trend(brand(spark, sf_dir)), -1).select("symbol", "ts", "position")


_DH = f"""ch AS (SELECT symbol, ts, close,
  CASE WHEN count(*) OVER u = 20 THEN max(high) OVER u END AS up, CASE WHEN count(*) OVER l = 10 THEN min(low) OVER l END AS dn FROM bars
  WINDOW u AS ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), l AS ({BY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
pos AS (SELECT symbol, ts, close, coalesce(last_value(CASE WHEN close > up THEN 1 WHEN close < dn THEN 0 END IGNORE NULLS)
  OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position FROM ch)"""


@query("i11_donchian_hold", with_(BRAND, _DH) + "SELECT symbol, ts, position FROM pos")
def i11(spark, sf_dir):
    return bt.donchian_hold(brand(spark, sf_dir)).select("symbol", "ts", "position")


SRET = (f"""sr AS (SELECT symbol, ts, close, position, close / lag(close) OVER ({BY}) - 1 AS ar, lag(position) OVER ({BY}) AS pp FROM pos)""",
        f"""rr AS (SELECT symbol, ts, close, position, coalesce(abs(position - pp), 0) AS turnover,
  coalesce(pp, 0) * coalesce(ar, 0) - coalesce(abs(position - pp), 0) * 0.0005 AS ret FROM sr)""",
        f"eq AS (SELECT *, 100000 * product(1 + ret) OVER ({BY}) AS equity FROM rr)")


@query("i12_strategy_returns", with_(BRAND, *temacd_sql(), *_machine(0), *SRET, recursive=True) +
       f"SELECT symbol, ts, {r('ret')}, {r('equity', digits=3)} FROM eq")
def i12(spark, sf_dir):
    pos = bt.state_position(_cond(brand(spark, sf_dir)), 0)
    df = bt.strategy_returns(pos)
    return df.select("symbol", "ts", F.round("ret", 6).alias("ret"), F.round("equity", 3).alias("equity"))


TRADES = (f"b AS (SELECT *, row_number() OVER ({BY}) - 1 AS bar, lag(position, 1, 0) OVER ({BY}) AS pp FROM pos)",
          f"""trn AS (SELECT *, lead(ts) OVER ({BY}) AS exit_ts, lead(close) OVER ({BY}) AS exit_px, lead(bar) OVER ({BY}) AS exit_bar
  FROM b WHERE position <> coalesce(pp, 0))""",
          """trades AS (SELECT symbol, CASE WHEN position = 1 THEN 'long' ELSE 'short' END AS side, ts AS entry_ts, exit_ts, close AS entry_px,
  exit_px, bar AS entry_bar, exit_bar, position * (exit_px - close) / close AS pnl_pct FROM trn WHERE position <> 0 AND exit_ts IS NOT NULL)""")


@query("i13_closed_trades", with_(BRAND, *DON_TREND, *_machine(-1), *TRADES, recursive=True) +
       f"SELECT symbol, side, entry_ts, exit_ts, entry_bar, exit_bar, {r('entry_px')}, {r('exit_px')}, {r('pnl_pct')} FROM trades")
def i13(spark, sf_dir):
    pos = bt.state_position(sig.donchian_trend(brand(spark, sf_dir)), -1)
    return rounded(bt.closed_trades(pos).drop("strategy"))


@query("d11_trade_metrics", with_(BRAND, *DON_TREND, *_machine(-1), *TRADES, recursive=True) + f"""SELECT symbol,
  {r('count(CASE WHEN pnl_pct > 0 THEN 1 END) * 100.0 / count(*)', 'win_rate')},
  {r('coalesce(sum(pnl_pct) FILTER (pnl_pct > 0), 0) / nullif(abs(sum(pnl_pct) FILTER (pnl_pct <= 0)), 0)', 'profit_factor')},
  {r('coalesce(avg(pnl_pct) FILTER (pnl_pct > 0), 0)', 'avg_win')}, {r('coalesce(avg(pnl_pct) FILTER (pnl_pct <= 0), 0)', 'avg_loss')},
  count(*) AS num_trades, {r('sum(pnl_pct)', 'total_pnl')} FROM trades GROUP BY symbol""")
def d11(spark, sf_dir):
    pos = bt.state_position(sig.donchian_trend(brand(spark, sf_dir)), -1)
    return rounded(bt.trade_metrics(bt.closed_trades(pos)))


_I14 = (*EWMAC_CTES, _DH.replace("high", "close").replace("low)", "close)"),
        f"""al AS (SELECT f.symbol, f.ts, f.close, forecast, greatest(-5, least(5, forecast / 10)) AS carver, position AS donchian,
  f.close / lag(f.close) OVER (PARTITION BY f.symbol ORDER BY f.ts) - 1 AS ret FROM fc f JOIN pos p USING (symbol, ts))""",
        f"""av AS (SELECT *, 0.5 * carver + donchian AS blended,
  coalesce(({roll('stddev_samp(ret)', 'ret', 25)}) * sqrt(252.0), 0.5) AS asset_vol FROM al)""",
        f"""st AS (SELECT *, coalesce(ret, 0) * coalesce(lag(carver) OVER ({BY}), 0) AS rc, coalesce(ret, 0) * coalesce(lag(donchian) OVER ({BY}), 0) AS rd,
  coalesce(ret, 0) * coalesce(lag(blended) OVER ({BY}), 0) AS rb FROM av)""")


@query("i14_continuous_allocation", with_(BRAND, *_I14, recursive=True) + f"""SELECT symbol, ts, {r('carver', 'carver_allocation', 4)},
  donchian AS donchian_allocation, {r('blended', 'blended_allocation', 4)}, {r('asset_vol', digits=5)},
  {r(f'100000 * product(1 + rc) OVER ({BY})', 'equity_carver', 1)}, {r(f'100000 * product(1 + rd) OVER ({BY})', 'equity_donchian', 1)},
  {r(f'100000 * product(1 + rb) OVER ({BY})', 'equity_blended', 1)} FROM st""")
def i14(spark, sf_dir):
    df = bt.continuous_allocation(brand(spark, sf_dir))
    return df.select("symbol", "ts", F.round("carver_allocation", 4).alias("carver_allocation"), "donchian_allocation",
                     F.round("blended_allocation", 4).alias("blended_allocation"), F.round("asset_vol", 5).alias("asset_vol"),
                     *[F.round(f"equity_{k}", 1).alias(f"equity_{k}") for k in ("carver", "donchian", "blended")])


@query("i17_buy_and_hold", with_(BRAND) + f"SELECT symbol, {r('max_by(close, ts) / min_by(close, ts) - 1', 'buy_hold_return')} FROM bars GROUP BY symbol")
def i17(spark, sf_dir):
    return rounded(bt.buy_and_hold(bars_brand(spark, sf_dir)))


_RSI = f"""d AS (SELECT symbol, ts, close, volume, close - lag(close) OVER ({BY}) AS d, row_number() OVER ({BY}) - 1 AS ri FROM bars),
g AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0.0 END AS up, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS dn FROM d),
rs AS (SELECT symbol, ts, volume, coalesce(100 - 100 / (1 + ({roll('avg(up)', 'up', 14)}) / nullif({roll('avg(dn)', 'dn', 14)}, 0)), 50) AS rsi FROM g)"""


@query("i18_trend_rule", with_(BRAND, ema("e", "bars", {"e50": ("close", 50)}, keep="close"), _RSI, recursive=True) + """SELECT symbol, ts,
  close > e50 AND rsi < 70 AND volume > 100 AS long, close < e50 OR rsi > 80 AS short FROM e JOIN rs USING (symbol, ts)""")
def i18(spark, sf_dir):
    return sig.trend_rule(brand(spark, sf_dir), 100.0).select("symbol", "ts", "long", "short")


@query("i18_momentum_rule", with_(BRAND, ema("e", "bars", {"e200": ("close", 200)}, keep="close"), f"""m AS (SELECT *, close / lag(close, 252) OVER ({BY})
  - close / lag(close, 21) OVER ({BY}) AS m FROM e)""", recursive=True) + """SELECT symbol, ts,
  coalesce(m > 0.1 AND close > e200, false) AS long, coalesce(m < 0, false) OR close < e200 AS short FROM m""")
def i18b(spark, sf_dir):
    return sig.momentum_rule(brand(spark, sf_dir)).select("symbol", "ts", "long", "short")


@query("i18_pair_ratio_rule", with_(MARKET, """pr AS (SELECT a.symbol, a.ts, a.close / b.close AS close FROM bars a JOIN bars b ON a.ts = b.ts
  WHERE a.symbol = 'XLU' AND b.symbol = 'SPY')""", ema("e", "pr", {"ma": ("close", 20)}, keep="close"),
  f"l AS (SELECT *, lag(close) OVER ({BY}) AS cp, lag(ma) OVER ({BY}) AS mp FROM e)", recursive=True) + """SELECT symbol, ts,
  coalesce(close > ma AND cp <= mp, false) AS long, coalesce(close < ma AND cp >= mp, false) AS short FROM l""")
def i18c(spark, sf_dir):
    return sig.pair_ratio_rule(bars_market(spark, sf_dir), "XLU", "SPY").select("symbol", "ts", "long", "short")


@query("d25_signal_counts", with_(BRAND, *SCREEN, recursive=True) + """SELECT count(*) FILTER (signal = 'LONG ENTRY') AS long_entries,
  count(*) FILTER (signal = 'SHORT/EXIT') AS short_exits, count(*) FILTER (signal = 'HOLD') AS holds,
  count(*) FILTER (trend LIKE '%STRONG BULL%') AS strong_bulls FROM screen""")
def d25(spark, sf_dir):
    return sig.signal_counts(sig.screener(brand(spark, sf_dir)))


@query("b3_only_signals", with_(BRAND, *SCREEN, recursive=True) + "SELECT symbol, date, signal FROM screen WHERE signal <> 'HOLD'")
def b3(spark, sf_dir):
    return sig.screener(brand(spark, sf_dir)).where(F.col("signal") != "HOLD").select("symbol", "date", "signal")


@query("b4_direction_gate", with_(BRAND, *EMA_CROSS, recursive=True) + """SELECT symbol, ts,
  long AND ts BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AS long, false AS short FROM cond""")
def b4(spark, sf_dir):
    df = sig.direction_gate(sig.ema_cross(brand(spark, sf_dir)), "1996-01-01", "1999-12-31", "long")
    return df.select("symbol", "ts", "long", "short")


@query("f2_last_row", with_(BRAND) + f"""SELECT symbol, max(ts) AS ts, {r('max_by(close, ts)', 'close')}, {r('max_by(volume, ts)', 'volume')}
  FROM bars GROUP BY symbol""")
def f2(spark, sf_dir):
    return rounded(sig.last_row(bars_brand(spark, sf_dir).select("symbol", "ts", "close", "volume")))


@query("f3_ordered_signals", with_(BRAND, *SCREEN, recursive=True) + """SELECT symbol, signal FROM screen ORDER BY
  CASE signal WHEN 'LONG ENTRY' THEN 0 WHEN 'SHORT/EXIT' THEN 1 ELSE 2 END, symbol""")
def f3(spark, sf_dir):
    return sig.screener(brand(spark, sf_dir)).select("symbol", "signal").orderBy(sig.signal_order(), "symbol")


@query("h1_change_pct", with_(BRAND) + f"SELECT symbol, ts, {r(f'(close - lag(close) OVER ({BY})) / lag(close) OVER ({BY}) * 100', 'chg_pct')} FROM bars")
def h1(spark, sf_dir):
    df = brand(spark, sf_dir)
    return rounded(df.select("symbol", "ts", (F.try_divide(F.col("close") - F.col("_pc"), F.col("_pc")) * 100).alias("chg_pct")))


@query("h2_trend_label", with_(BRAND, *temacd_sql(), recursive=True) + """SELECT symbol, ts,
  {TREND} AS trend,
  CASE WHEN ema1 > ema2 AND ema2 > ema3 THEN 'STRONG BULL' WHEN ema1 > ema2 THEN 'BULLISH'
    WHEN ema1 < ema2 AND ema2 < ema3 THEN 'STRONG BEAR' ELSE 'BEARISH' END AS chart_trend FROM td""")
def h2(spark, sf_dir):
    df = sig.temacd(brand(spark, sf_dir))
    e = (F.col("ema1"), F.col("ema2"), F.col("ema3"))
    return df.select("symbol", "ts", sig.trend_label(*e).alias("trend"), sig.trend_label(*e, neutral=False).alias("chart_trend"))


@query("h3_triggers", with_(BRAND, *temacd_sql(), recursive=True) + f"""SELECT symbol, ts,
  CASE WHEN len({TRIG}) > 0 THEN array_to_string({TRIG}, '; ') ELSE '-' END AS triggers FROM cond""")
def h3(spark, sf_dir):
    df = sig.temacd_conditions(brand(spark, sf_dir))
    return df.select("symbol", "ts", F.array_join(sig.trigger_array(), "; ").alias("triggers"))


@query("h5_contracts", with_(BRAND, *temacd_sql(), *_machine(0), *SRET, recursive=True) +
       f"SELECT symbol, ts, {r('equity / close * 1.5', 'contracts', 3)} FROM eq")
def h5(spark, sf_dir):
    df = bt.strategy_returns(bt.state_position(_cond(brand(spark, sf_dir)), 0))
    return df.select("symbol", "ts", F.round(bt.contracts(F.col("equity"), F.col("close"), 1.5), 3).alias("contracts"))


@query("h4_vol_target_lots", with_(BRAND, f"ret AS (SELECT symbol, ts, close, close / lag(close) OVER ({BY}) - 1 AS ret FROM bars)",
       f"v AS (SELECT symbol, ts, close, ({roll('stddev_samp(ret)', 'ret', 25)}) * sqrt(252.0) AS av FROM ret)") + f"""SELECT symbol, ts,
  {r('CASE WHEN av > 0 AND close > 0 THEN 100000 * 0.2 / (av * close * 5) ELSE 0.0 END', 'lots', 5)} FROM v""")
def h4(spark, sf_dir):
    df = feat.compute(brand(spark, sf_dir), {"av": feat.rolling_volatility(25)})
    size = bt.lots(F.lit(100000.0), 0.2, F.col("av"), F.col("close"), F.lit(5.0))
    return df.select("symbol", "ts", F.round(F.coalesce(size, F.lit(0.0)), 5).alias("lots"))
