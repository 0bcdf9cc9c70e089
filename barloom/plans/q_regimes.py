"""Regime queries: every date is scored."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import rounded
from barloom.operators import regimes as reg, signals as sig
from barloom.plans import dims
from barloom.plans.catalog import query
from barloom.plans.inputs import market
from barloom.plans.sqltext import BY, MARKET, ema, r, with_
from barloom.sources.derived import bars_market

_ROLES = ", ".join(f"'{s}'" for s in (*reg.ROLES, *reg.VIX_NAMES))
_WIDE = (
    f"rb AS (SELECT * FROM bars WHERE symbol IN ({_ROLES}))",
    ema("re", "rb", {"e50": ("close", 50), "e200": ("close", 200)}, keep="close"),
    f"rf AS (SELECT *, close / lag(close, 20) OVER ({BY}) - 1 AS r20, i + 1 AS n FROM re)",
    "cal AS (SELECT DISTINCT ts FROM rb)",
    "fst AS (SELECT symbol, min(ts) AS t0 FROM rb GROUP BY symbol)",
    """pan AS (SELECT f.symbol, c.ts, last_value(x.close IGNORE NULLS) OVER w AS close, last_value(x.e50 IGNORE NULLS) OVER w AS e50,
  last_value(x.e200 IGNORE NULLS) OVER w AS e200, last_value(x.r20 IGNORE NULLS) OVER w AS r20, last_value(x.n IGNORE NULLS) OVER w AS n
  FROM fst f JOIN cal c ON c.ts >= f.t0 LEFT JOIN rf x ON x.symbol = f.symbol AND x.ts = c.ts
  WINDOW w AS (PARTITION BY f.symbol ORDER BY c.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "wide AS (SELECT ts, " + ", ".join(f"max(r20) FILTER (symbol = '{s}') AS r_{s}, count(*) FILTER (symbol = '{s}') > 0 AS has_{s}" for s in reg.ROLES) +
    ", max(close) FILTER (symbol = 'VIXY') AS vix, max(close) FILTER (symbol = 'SPY') AS spy_price, max(e50) FILTER (symbol = 'SPY') AS e50, "
    "max(e200) FILTER (symbol = 'SPY') AS e200, max(n) FILTER (symbol = 'SPY') AS n FROM pan GROUP BY ts)",
)


def _z(s: str) -> str:
    return f"coalesce(r_{s}, 0)"


_MACRO = "mac AS (SELECT ts, coalesce(vix, 18) AS vix, " + ", ".join(
    f"{_z(a)} - {_z(b)} AS {n}" for n, a, b in reg.MACRO_SPREADS) + ", spy_price, e200 AS spy_ema200 FROM wide)"
_SIX = """six AS (SELECT *, CASE WHEN vix >= 30 OR hyg_ief <= -0.04 THEN 6 WHEN hyg_ief < -0.012 AND xlu_spy > 0.008 THEN 5
  WHEN xlu_spy > 0.005 AND xly_xlp < -0.005 THEN 4 WHEN vix >= 18 AND vix < 25 THEN 3
  WHEN xle_xlu > 0.008 AND xlb_gld > 0.005 THEN 2 ELSE 1 END AS regime_id FROM mac)"""
_DIM = "rg(regime_id, regime, eq, hedge, cash, engine) AS (" + dims.values(dims.REGIMES) + ")"
BASE = (MARKET, *_WIDE)


def _wide(spark, sf_dir):
    return reg.inputs(bars_market(spark, sf_dir))


_SPREAD_NAMES = [n for n, _, _ in reg.MACRO_SPREADS]


@query("n1_macro_table", with_(*BASE, _MACRO, recursive=True) + "SELECT ts, " + ", ".join(
    r(c, digits=6) for c in ["vix", *_SPREAD_NAMES, "spy_price", "spy_ema200"]) + " FROM mac")
def n1(spark, sf_dir):
    return rounded(reg.macro(_wide(spark, sf_dir)), 6)


@query("n2_six_regimes", with_(*BASE, _MACRO, _SIX, recursive=True) + "SELECT ts, regime_id FROM six")
def n2(spark, sf_dir):
    return reg.classify(reg.macro(_wide(spark, sf_dir))).select("ts", "regime_id")


@query("n3_regime_allocation", with_(*BASE, _MACRO, _SIX, _DIM, recursive=True) +
       "SELECT ts, regime, eq, hedge, cash, engine FROM six JOIN rg USING (regime_id)")
def n3(spark, sf_dir):
    df = reg.with_allocation(reg.classify(reg.macro(_wide(spark, sf_dir))))
    return df.select("ts", "regime", "eq", "hedge", "cash", "engine")


def _three(x: str, up: float, down: float, vals: list[tuple]) -> list[str]:
    """signal, confidence, probability CASEs; vals: up, down, middle."""
    out = []
    for k, null in enumerate(("'Neutral'", "0.0", "0.5")):
        v = [str(row[k]) for row in vals]
        out.append(f"CASE WHEN {x} IS NULL THEN {null} WHEN {x} > {up} THEN {v[0]} WHEN {x} < {down} THEN {v[1]} ELSE {v[2]} END")
    return out


def _canary_sql(name: str) -> str:
    spread = {"XLUCanary": "r_XLU - r_SPY", "QQQCanary": "r_QQQ - r_SPY", "CreditSpreadCanary": "r_HYG - r_IEF",
              "ConsumerCanary": "r_XLY - r_XLP", "YieldCurveCanary": "r_TLT - r_IEF", "DollarCanary": "r_UUP - r_SPY",
              "OilCanary": "r_XLE - r_SPY", "GoldCanary": "r_GLD - r_SPY"}
    x = f"({spread[name]})" if name in spread else "vix"
    c10, c8 = f"least(0.9, 0.5 + abs({x}) * 10)", f"least(0.9, 0.5 + abs({x}) * 8)"
    mid3, mid4 = ("'Neutral'", 0.3, 0.5), ("'Neutral'", 0.4, 0.5)
    spec = {
        "XLUCanary": (0.005, -0.005, [("'RiskOff'", c10, f"CASE WHEN {x} > 0.01 THEN 0.8 ELSE 0.65 END"), ("'RiskOn'", c10, 0.7), mid3], 0.72, 1.0),
        "QQQCanary": (0.005, -0.005, [("'RiskOn'", c8, 0.75), ("'RiskOff'", c8, 0.65), mid3], 0.70, 1.0),
        "CreditSpreadCanary": (0.01, -0.012, [("'RiskOn'", 0.75, 0.75), ("'RiskOff'", 0.85, 0.85), mid4], 0.78, 1.2),
        "ConsumerCanary": (0.005, -0.005, [("'RiskOn'", 0.7, 0.7), ("'RiskOff'", 0.7, 0.7), mid3], 0.69, 1.0),
        "YieldCurveCanary": (0.01, -0.01, [("'RiskOff'", 0.65, 0.65), ("'RiskOn'", 0.6, 0.6), mid3], 0.66, 1.0),
        "DollarCanary": (0.01, -0.01, [("'RiskOff'", 0.6, 0.6), ("'RiskOn'", 0.55, 0.55), mid3], 0.62, 0.8),
        "OilCanary": (0.015, -0.015, [("'Inflation'", 0.7, 0.7), ("'Deflation'", 0.6, 0.6), mid3], 0.67, 1.0),
        "GoldCanary": (0.015, -0.015, [("'SafeHaven'", 0.7, 0.7), ("'RiskOn'", 0.6, 0.6), mid3], 0.68, 1.0),
    }
    if name == "VIXCanary":
        parts = []
        for a in (("'BlackSwan'", "'RiskOff'", "'RiskOn'", "'Neutral'", "'Neutral'"), (0.95, 0.8, 0.75, 0.4, 0.0), (0.9, 0.75, 0.7, 0.5, 0.5)):
            parts.append(f"CASE WHEN vix IS NULL THEN {a[4]} WHEN vix >= 30 THEN {a[0]} WHEN vix >= 25 THEN {a[1]} WHEN vix <= 18 THEN {a[2]} ELSE {a[3]} END")
        acc, weight = 0.82, 1.5
    else:
        up, down, vals, acc, weight = spec[name]
        parts = _three(x, up, down, vals)
    return (f"SELECT ts, '{name}' AS name, {parts[0]} AS signal, CAST({parts[1]} AS DOUBLE) AS confidence, CAST({parts[2]} AS DOUBLE) AS probability, "
            f"{acc}::DOUBLE AS accuracy, {weight}::DOUBLE AS weight, CAST(coalesce({x}, 0) AS DOUBLE) AS value FROM wide")


_CANARY_OUT = f"SELECT ts, signal, {r('confidence')}, {r('probability')}, {r('value')} FROM cn"


def _register_canary(key: str, name: str) -> None:
    @query(key, with_(*BASE, f"cn AS ({_canary_sql(name)})", recursive=True) + _CANARY_OUT)
    def run(spark, sf_dir):
        return rounded(reg.canaries(_wide(spark, sf_dir), [name]).select("ts", "signal", "confidence", "probability", "value"))


for _k, _n in (("n4_xlu_canary", "XLUCanary"), ("n5_qqq_canary", "QQQCanary"), ("n6_credit_canary", "CreditSpreadCanary"),
               ("n7_consumer_canary", "ConsumerCanary"), ("n8_vix_canary", "VIXCanary"), ("n9_yield_canary", "YieldCurveCanary"),
               ("n10_dollar_canary", "DollarCanary"), ("n11_oil_canary", "OilCanary"), ("n12_gold_canary", "GoldCanary")):
    _register_canary(_k, _n)

_ALL = "cn AS (" + " UNION ALL ".join(_canary_sql(n) for n in reg.CANARIES) + ")"
_VOTE = """vs AS (SELECT ts, coalesce(sum(confidence * weight * accuracy) FILTER (signal = 'RiskOn'), 0) AS risk_on,
  coalesce(sum(confidence * weight * accuracy) FILTER (signal IN ('RiskOff', 'Defensive')), 0) AS risk_off,
  2 * coalesce(sum(confidence * weight * accuracy) FILTER (signal = 'BlackSwan'), 0) AS black_swan,
  coalesce(sum(confidence * weight * accuracy) FILTER (signal IN ('Inflation', 'SafeHaven')), 0) AS inflation,
  bool_or(signal = 'BlackSwan' AND confidence > 0.8) AS swan, bool_or(name = 'CreditSpreadCanary' AND signal = 'RiskOff') AS credit,
  bool_or(name = 'XLUCanary' AND signal = 'RiskOff') AS xlu, bool_or(name = 'ConsumerCanary' AND signal = 'RiskOff') AS consumer,
  bool_or(name = 'VIXCanary' AND signal = 'Neutral' AND value >= 18 AND value < 25) AS rng FROM cn GROUP BY ts),
vt AS (SELECT ts, CASE WHEN black_swan > 0.5 OR swan THEN 'BLACK_SWAN_VOL_SHOCK' WHEN risk_off > 1.0 AND credit THEN 'CREDIT_STRESS'
  WHEN xlu AND consumer THEN 'DEFENSIVE_ROTATION' WHEN rng THEN 'RANGE_BOUND_WHIPSAW' WHEN inflation > 0.6 THEN 'INFLATION_GROWTH'
  WHEN risk_on >= risk_off THEN 'RISK_ON_GROWTH' ELSE 'DEFENSIVE_ROTATION' END AS regime,
  CASE WHEN black_swan > 0.5 OR swan THEN least(1, black_swan) WHEN risk_off > 1.0 AND credit THEN least(1, risk_off / 2)
  WHEN xlu AND consumer THEN 0.75 WHEN rng THEN 0.65 WHEN inflation > 0.6 THEN least(1, inflation)
  WHEN risk_on >= risk_off THEN least(1, 0.5 + risk_on / 3) ELSE 0.6 END AS confidence FROM vs)"""


@query("n13_canary_vote", with_(*BASE, _ALL, _VOTE, recursive=True) + f"SELECT ts, regime, {r('CAST(confidence AS DOUBLE)', 'confidence')} FROM vt")
def n13(spark, sf_dir):
    return rounded(reg.vote(reg.canaries(_wide(spark, sf_dir))).select("ts", "regime", "confidence"))


# a canary switched off, two with other weights, a layer switched off and one of the user's own
_SETTINGS = [("GoldCanary", False, None), ("VIXCanary", True, 2.0), ("XLUCanary", None, 0.5), ("DollarRegime", False, None), ("CreditRegime", True, 0.7)]
_SETTINGS_SQL = "st(name, enabled, weight) AS (SELECT n, CAST(e AS BOOLEAN), CAST(w AS DOUBLE) FROM (" + dims.values(_SETTINGS) + ") t(n, e, w))"
_OWN = """SELECT ts, 'SmallCapCanary' AS name, CASE WHEN r_IWM - r_SPY > 0.01 THEN 'RiskOn' WHEN r_IWM - r_SPY < -0.01 THEN 'RiskOff' ELSE 'Neutral' END AS signal,
  CASE WHEN r_IWM - r_SPY IS NULL THEN 0.0 WHEN abs(r_IWM - r_SPY) > 0.01 THEN 0.7 ELSE 0.3 END AS confidence, 0.5 AS probability, 0.65::DOUBLE AS accuracy, 1.0::DOUBLE AS weight,
  coalesce(r_IWM - r_SPY, 0) AS value FROM wide"""
_CONFIGURED = (_ALL.replace("cn AS (", "ca AS (", 1)[:-1] + " UNION ALL " + _OWN + ")", _SETTINGS_SQL,
               """cn AS (SELECT ts, ca.name, signal, confidence, probability, accuracy, coalesce(st.weight, ca.weight) AS weight, value
  FROM ca LEFT JOIN st USING (name) WHERE coalesce(enabled, true))""")


@query("j3_plugged_in_vote", with_(*BASE, *_CONFIGURED, _VOTE, recursive=True) + f"SELECT ts, regime, {r('CAST(confidence AS DOUBLE)', 'confidence')}, {r('risk_on')}, {r('risk_off')} FROM vt JOIN vs USING (ts)")
def j3(spark, sf_dir):
    """The vote with a canary of the user's own, and with flags and weights from a table."""
    settings = dims.frame(spark, _SETTINGS, "name string, enabled boolean, weight double")
    own = reg.spread_canary("SmallCapCanary", "IWM", "SPY", 0.01)
    vote = reg.vote(reg.canaries(_wide(spark, sf_dir), extra=(own,), settings=settings))
    return rounded(vote.select("ts", "regime", "confidence", "risk_on", "risk_off"))


_RULES = ("rl(rule, regime, confidence, priority, logic) AS (" + dims.values(dims.RULES) + ")",
          "cd(rule, canary, field, op, expected) AS (" + dims.values(dims.RULE_CONDITIONS) + ")",
          """ct AS (SELECT c.ts, d.rule, d.canary, d.op, d.expected, CASE d.op WHEN '==' THEN c.signal = d.expected
  WHEN '>=' THEN c.value >= try_cast(d.expected AS DOUBLE) WHEN '<' THEN c.value < try_cast(d.expected AS DOUBLE) END AS met
  FROM cn c JOIN cd d ON d.canary = c.name)""",
          "rt AS (SELECT ts, rule, bool_and(met) AS a, bool_or(met) AS o FROM ct GROUP BY ts, rule)",
          "fr AS (SELECT rt.ts, rl.* FROM rt JOIN rl USING (rule) WHERE CASE logic WHEN 'AND' THEN a ELSE o END)",
          "tp AS (SELECT ts, max_by(rule, priority) AS rule, max_by(regime, priority) AS regime, max_by(confidence, priority) AS confidence, count(*) AS n FROM fr GROUP BY ts)",
          "mj AS (SELECT ts, signal, count(*) AS votes, min(name) AS f FROM cn GROUP BY ts, signal)",
          "mw AS (SELECT ts, signal, votes, row_number() OVER (PARTITION BY ts ORDER BY votes DESC, f) AS k FROM mj)",
          "sr(signal, fallback) AS (" + dims.values(dims.SIGNAL_TO_REGIME) + ")")


@query("n14_expert_system", with_(*BASE, _ALL, *_RULES, recursive=True) + """SELECT mw.ts, tp.rule, coalesce(tp.regime, fallback, 'RISK_ON_GROWTH') AS final_regime,
  coalesce(tp.confidence, 0.5)::DOUBLE AS confidence, coalesce(n, 0) AS fired_count FROM mw LEFT JOIN tp USING (ts) LEFT JOIN sr USING (signal) WHERE k = 1""")
def n14(spark, sf_dir):
    return reg.expert_system(reg.canaries(_wide(spark, sf_dir)), *reg.default_rules(spark))


@query("b15_rule_conditions", with_(*BASE, _ALL, *_RULES, recursive=True) + "SELECT ts, rule, canary, op, expected, coalesce(met, false) AS met FROM ct")
def b15(spark, sf_dir):
    from barloom.session import cut
    cn = cut(reg.canaries(_wide(spark, sf_dir)))
    return reg.condition_table(cn, reg.default_rules(spark)[1]).drop("field")


@query("d32_vote_counts", with_(*BASE, _ALL, *_RULES, recursive=True) + "SELECT ts, signal, votes, k = 1 AS winner FROM mw")
def d32(spark, sf_dir):
    return reg.vote_counts(reg.canaries(_wide(spark, sf_dir)))


def _term(a: str, b: str, w: float) -> str:
    return f"CASE WHEN has_{a} AND has_{b} THEN ({_z(a)} - {_z(b)}) * {w}::DOUBLE ELSE 0 END"


_X = {"MacroRegime": [("XLI", "XLU", 1.0), ("IWM", "SPY", 0.8), ("XLB", "GLD", 0.6)], "LiquidityRegime": [("HYG", "IEF", 1.0), ("IWM", "SPY", 0.8)],
      "CreditRegime": [("HYG", "IEF", 1.0), ("LQD", "TLT", 0.7)], "InflationRegime": [("TIP", "IEF", 1.2), ("XLE", "XLU", 0.8), ("GLD", "TLT", 0.5)],
      "DollarRegime": [("UUP", "SPY", 1.0), ("UUP", "GLD", 0.5)]}


def _layer_sql(name: str) -> str:
    """Cases: condition, regime, probability, confidence, duration, hit rate."""
    x, v, away = "x", "x", "(spy_price / e200 - 1)"
    src = f"SELECT *, {' + '.join(_term(*t) for t in _X[name])} AS x FROM wide" if name in _X else "SELECT *, coalesce(vix, 0) AS x FROM wide"
    cases = {
        "MacroRegime": (1.2, [("x > 0.015", "'Expansion'", "least(0.9, 0.6 + abs(x) * 10)", "least(0.9, 0.5 + abs(x) * 8)", 120, 0.68),
                              ("x < -0.015", "'Contraction'", "least(0.9, 0.6 + abs(x) * 10)", "least(0.9, 0.5 + abs(x) * 8)", 90, 0.68)], ("'Neutral'", 0.55, 0.4, 45, 0.68)),
        "VolatilityRegime": (1.5, [("vix IS NULL", "'Normal'", 0.5, 0.0, 30, 0.75), ("vix >= 30", "'BlackSwan'", 0.95, 0.9, 7, 0.85),
                                   ("vix >= 25", "'HighVol'", 0.8, 0.75, 15, 0.78), ("vix >= 18", "'NormalVol'", 0.6, 0.5, 30, 0.65)], ("'LowVol'", 0.75, 0.7, 60, 0.72)),
        "TrendRegime": (1.2, [("coalesce(n < 210, true)", "'Sideways'", 0.5, 0.0, 20, 0.6),
                              ("spy_price > e200 AND e50 > e200", "'Uptrend'", f"least(0.9, 0.6 + abs({away}) * 5)", f"least(0.85, 0.5 + abs({away}) * 4)", 120, 0.7),
                              ("spy_price < e200 AND e50 < e200", "'Downtrend'", f"least(0.9, 0.6 + abs({away}) * 5)", f"least(0.85, 0.5 + abs({away}) * 4)", 60, 0.68)],
                        ("'Sideways'", 0.55, 0.4, 30, 0.6)),
        "LiquidityRegime": (1.0, [("x > 0.01", "'HighLiquidity'", "least(0.85, 0.6 + abs(x) * 10)", 0.7, 90, 0.65), ("x < -0.01", "'LowLiquidity'", "least(0.85, 0.6 + abs(x) * 10)", 0.75, 30, 0.72)],
                            ("'NeutralLiquidity'", 0.5, 0.4, 45, 0.6)),
        "CreditRegime": (1.3, [("x < -0.02", "'CreditStress'", 0.9, 0.85, 20, 0.78), ("x < -0.005", "'CreditRiskOff'", 0.7, 0.65, 40, 0.7), ("x > 0.01", "'CreditRiskOn'", 0.75, 0.7, 90, 0.72)],
                         ("'CreditNeutral'", 0.5, 0.4, 60, 0.6)),
        "InflationRegime": (1.1, [("x > 0.015", "'HighInflation'", 0.75, 0.7, 180, 0.65), ("x < -0.015", "'LowInflation'", 0.7, 0.65, 120, 0.62)], ("'NeutralInflation'", 0.5, 0.4, 90, 0.58)),
        "DollarRegime": (0.9, [("x > 0.01", "'DollarStrength'", 0.7, 0.65, 60, 0.64), ("x < -0.01", "'DollarWeakness'", 0.7, 0.65, 60, 0.64)], ("'DollarNeutral'", 0.5, 0.4, 45, 0.58)),
    }
    weight, rows, last = cases[name]

    def part(k):
        return "CASE " + " ".join(f"WHEN {c[0]} THEN {c[k + 1]}" for c in rows) + f" ELSE {last[k]} END"
    if name == "TrendRegime":
        v = f"CASE WHEN coalesce(n < 210, true) THEN 0 WHEN (spy_price > e200 AND e50 > e200) OR (spy_price < e200 AND e50 < e200) THEN {away} ELSE 0 END"
    return (f"SELECT ts, '{name}' AS layer, {part(0)} AS regime, CAST({part(1)} AS DOUBLE) AS probability, CAST({part(2)} AS DOUBLE) AS confidence, "
            f"{part(3)} AS expected_duration_days, CAST({part(4)} AS DOUBLE) AS hit_rate, {weight}::DOUBLE AS weight, CAST({v} AS DOUBLE) AS value FROM ({src})")


def _register_layer(key: str, name: str) -> None:
    @query(key, with_(*BASE, f"ly AS ({_layer_sql(name)})", recursive=True) +
           f"SELECT ts, regime, {r('probability')}, {r('confidence')}, expected_duration_days, {r('hit_rate')}, {r('value')} FROM ly")
    def run(spark, sf_dir):
        return rounded(reg.layers(_wide(spark, sf_dir), [name]).drop("layer", "weight"))


for _k, _n in (("n15_macro_layer", "MacroRegime"), ("n16_volatility_layer", "VolatilityRegime"), ("n17_trend_layer", "TrendRegime"),
               ("n18_liquidity_layer", "LiquidityRegime"), ("n19_credit_layer", "CreditRegime"), ("n20_inflation_layer", "InflationRegime"),
               ("n21_dollar_layer", "DollarRegime")):
    _register_layer(_k, _n)

_ON, _OFF = (", ".join(f"'{x}'" for x in xs) for xs in (reg.RISK_ON, reg.RISK_OFF))
_META = ("ly AS (" + " UNION ALL ".join(_layer_sql(n) for n in reg.LAYERS) + ")",
         "lw AS (SELECT *, weight * confidence * hit_rate AS w FROM ly)",
         f"""ms AS (SELECT ts, coalesce(sum(w) FILTER (regime IN ({_ON})), 0) AS risk_on, coalesce(sum(w) FILTER (regime IN ({_OFF})), 0) AS risk_off,
  coalesce(sum(w) FILTER (regime = 'HighInflation'), 0) AS inflation, 2 * coalesce(sum(w) FILTER (regime = 'BlackSwan'), 0) AS black_swan,
  bool_or(regime = 'CreditStress') AS stress, sum(w) AS total, sum(w * expected_duration_days) AS days, """
         + ", ".join(f"max(w) FILTER (layer = '{n}') AS w_{n}" for n in reg.LAYERS) + " FROM lw GROUP BY ts)")


@query("n22_meta_regime", with_(*BASE, *_META, recursive=True) + f"""SELECT ts,
  CASE WHEN black_swan > 0.5 THEN 'BLACK_SWAN_VOL_SHOCK' WHEN risk_off > 1.5 AND stress THEN 'CREDIT_STRESS' WHEN risk_off > 1.5 THEN 'DEFENSIVE_ROTATION'
    WHEN inflation > 0.6 THEN 'INFLATION_GROWTH' WHEN risk_on >= risk_off THEN 'RISK_ON_GROWTH' ELSE 'RANGE_BOUND_WHIPSAW' END AS final_regime,
  {r('''CAST(CASE WHEN black_swan > 0.5 THEN least(1, 0.6 + black_swan) WHEN risk_off > 1.5 AND stress THEN 0.85 WHEN risk_off > 1.5 THEN 0.7
    WHEN inflation > 0.6 THEN 0.7 WHEN risk_on >= risk_off THEN least(1, 0.5 + risk_on / 3) ELSE 0.55 END AS DOUBLE)''', 'probability', 5)},
  {r("""CAST(CASE WHEN black_swan > 0.5 THEN least(1, 0.5 + black_swan) WHEN risk_off > 1.5 AND stress THEN 0.8 WHEN risk_off > 1.5 THEN 0.65
    WHEN inflation > 0.6 THEN 0.65 WHEN risk_on >= risk_off THEN least(1, 0.5 + risk_on / 4) ELSE 0.5 END AS DOUBLE)""", 'confidence', 5)},
  {', '.join(r(x, digits=5) for x in ('risk_on', 'risk_off', 'inflation', 'black_swan'))},
  CAST(coalesce(floor(round(days / nullif(total, 0), 9)), 30) AS INT) AS expected_duration_days,
  {', '.join(r(f'coalesce(w_{n} / nullif(total, 0), 0)', f'share_{n}', 4) for n in reg.LAYERS)} FROM ms""")
def n22(spark, sf_dir):
    """Regime, probability, confidence, the four scores, duration and the share of every layer."""
    df = reg.meta_regime(reg.layers(_wide(spark, sf_dir)))
    return df.select("ts", "final_regime", *[F.round(c, 5).alias(c) for c in ("probability", "confidence", "risk_on", "risk_off", "inflation", "black_swan")],
                     "expected_duration_days", *[F.element_at("contributions", n).alias(f"share_{n}") for n in reg.LAYERS])


@query("j3_configured_layers", with_(*BASE, _SETTINGS_SQL, _META[0].replace("ly AS (", "la AS (", 1),
       """ly AS (SELECT ts, layer, regime, confidence, hit_rate, expected_duration_days, coalesce(st.weight, la.weight) AS weight FROM la LEFT JOIN st ON st.name = la.layer WHERE coalesce(enabled, true))""",
       *_META[1:], recursive=True) + f"SELECT ts, {', '.join(r(x, digits=5) for x in ('risk_on', 'risk_off', 'inflation', 'black_swan'))} FROM ms")
def j3_layers(spark, sf_dir):
    settings = dims.frame(spark, _SETTINGS, "name string, enabled boolean, weight double")
    df = reg.meta_regime(reg.layers(_wide(spark, sf_dir), settings=settings))
    return rounded(df.select("ts", "risk_on", "risk_off", "inflation", "black_swan"), 5)


@query("b2_regime_filter", with_(*BASE, _MACRO, _SIX, "al(regime_id, symbol) AS (" + dims.values(dims.REGIME_ALLOWED) + ")",
       ema("ce", "bars", {"f0": ("close", 10), "s0": ("close", 40)}),
       "cm AS (SELECT symbol, ts, CASE WHEN i >= 9 THEN f0 END AS f, CASE WHEN i >= 39 THEN s0 END AS s FROM ce)",
       f"cl AS (SELECT *, lag(f) OVER ({BY}) AS fp, lag(s) OVER ({BY}) AS sp FROM cm)",
       "lg AS (SELECT symbol, ts FROM cl WHERE f > s AND fp <= sp)", recursive=True) + """SELECT lg.symbol, lg.ts, regime_id FROM lg JOIN six USING (ts)
  WHERE regime_id NOT IN (5, 6) AND (regime_id NOT IN (2, 4) OR EXISTS (SELECT 1 FROM al WHERE al.regime_id = six.regime_id AND al.symbol = lg.symbol))""")
def b2(spark, sf_dir):
    bars = market(spark, sf_dir)
    longs = sig.ema_cross(bars).where("long").select("symbol", "ts")
    ids = reg.classify(reg.macro(reg.inputs(bars))).select("ts", "regime_id")
    return reg.regime_filter(longs, ids)
