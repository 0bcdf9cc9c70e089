"""Market regimes: canaries, rules, layers and votes, scored on every date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.scalars import clip
from barloom.operators import features as feat
from barloom.operators.panel import panel
from barloom.operators.rotation import VIX_NAMES
from barloom.operators.timeline import ema_blocks, emas, expand, index_bars, own
from barloom.plans import dims
from barloom.session import cut

ROLES = ("XLU", "SPY", "XLY", "XLP", "XLB", "GLD", "HYG", "IEF", "XLK", "XLV", "XLE", "QQQ", "TLT", "UUP", "XLI",
         "IWM", "LQD", "TIP")


def inputs(bars: DataFrame) -> DataFrame:
    """One wide row per date: 20-bar returns, volatility index and SPY trend.

    Returns are taken over each symbol's own bars and carried forward to dates
    without a bar. ``r_X`` is NULL below 21 bars, ``has_X`` says X is listed.
    """
    bars = bars.where(F.col("symbol").isin(*ROLES, *VIX_NAMES))
    bars = bars if "_i" in bars.columns else index_bars(bars)
    df = feat.compute(bars.select("symbol", "ts", "close", "_i", "_pc"),
                      {"r20": feat.momentum(20), "v20": feat.rolling_volatility(20)}, keep_index=True)
    df = own(emas(ema_blocks(df), {"e50": (F.col("close"), 50), "e200": (F.col("close"), 200)}), drop_index=False)
    df = df.select("symbol", "ts", "close", "r20", "v20", "e50", "e200", (F.col("_i") + 1).cast("double").alias("bars"))
    p = panel(df, ("close", "r20", "v20", "e50", "e200", "bars"))

    def of(symbol: str, column: str) -> Column:
        return F.max(F.when(F.col("symbol") == symbol, F.col(column)))
    cols = {}
    for s in ROLES:
        cols[f"r_{s}"] = of(s, "r20")
        cols[f"has_{s}"] = F.count_if(F.col("symbol") == s) > 0
    level = F.coalesce(*[of(v, "close") for v in VIX_NAMES], of("SPY", "v20") * 100)
    return cut(p.groupBy("ts").agg(
        *[c.alias(n) for n, c in cols.items()], level.alias("vix"), of("SPY", "close").alias("spy_price"),
        of("SPY", "e50").alias("spy_ema50"), of("SPY", "e200").alias("spy_ema200"), of("SPY", "bars").alias("spy_bars")))


def _r(symbol: str) -> Column:
    return F.coalesce(F.col(f"r_{symbol}"), F.lit(0.0))


MACRO_SPREADS = (("xlu_spy", "XLU", "SPY"), ("xly_xlp", "XLY", "XLP"), ("xlb_gld", "XLB", "GLD"),
                 ("hyg_ief", "HYG", "IEF"), ("xlk_xlv", "XLK", "XLV"), ("xle_xlu", "XLE", "XLU"))


def macro(wide: DataFrame) -> DataFrame:
    """Macro table: volatility index, six monthly return spreads, SPY against its EMA200."""
    return wide.select("ts", F.coalesce(F.col("vix"), F.lit(18.0)).alias("vix"),
                       *[(_r(a) - _r(b)).alias(n) for n, a, b in MACRO_SPREADS], "spy_price", "spy_ema200")


def six_regime(vix: Column, hyg_ief: Column, xlu_spy: Column, xly_xlp: Column, xle_xlu: Column, xlb_gld: Column) -> Column:
    """Regime id 1-6 by the first matching line."""
    return (F.when((vix >= 30) | (hyg_ief <= -0.04), 6)
            .when((hyg_ief < -0.012) & (xlu_spy > 0.008), 5)
            .when((xlu_spy > 0.005) & (xly_xlp < -0.005), 4)
            .when((vix >= 18) & (vix < 25), 3)
            .when((xle_xlu > 0.008) & (xlb_gld > 0.005), 2)
            .otherwise(1))


def classify(m: DataFrame) -> DataFrame:
    c = F.col
    return m.withColumn("regime_id", six_regime(c("vix"), c("hyg_ief"), c("xlu_spy"), c("xly_xlp"), c("xle_xlu"), c("xlb_gld")))


def with_allocation(classified: DataFrame) -> DataFrame:
    """Add regime name and equity/hedge/cash percentages."""
    dim = dims.frame(classified.sparkSession, dims.REGIMES,
                     "regime_id int, regime string, eq int, hedge int, cash int, engine string")
    return classified.join(F.broadcast(dim), "regime_id")


def regime_filter(longs: DataFrame, regime_ids: DataFrame) -> DataFrame:
    """Keep long signals the regime allows: 5 and 6 none, 4 and 2 an allow-list, others all.

    ``regime_ids(ts, regime_id)`` joins on ``ts``.
    """
    allow = dims.frame(longs.sparkSession, dims.REGIME_ALLOWED, "regime_id int, symbol string").withColumn("_ok", F.lit(True))
    df = longs.join(regime_ids, "ts").where(~F.col("regime_id").isin(5, 6))
    df = df.join(F.broadcast(allow), ["regime_id", "symbol"], "left")
    return df.where(~F.col("regime_id").isin(2, 4) | F.col("_ok")).drop("_ok")


# -------------------------------------------------------------------- canaries

def _canary(name: str, signal: Column, confidence: Column, probability: Column, accuracy: float, weight: float,
            value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), signal.alias("signal"), confidence.cast("double").alias("confidence"),
                    probability.cast("double").alias("probability"), F.lit(accuracy).alias("accuracy"),
                    F.lit(weight).alias("weight"), value.cast("double").alias("value"))


def _three(x: Column, up_at: float, down_at: float, up, down, mid) -> tuple[Column, Column, Column]:
    """(signal, confidence, probability) by two thresholds; undefined x is a silent Neutral."""
    def part(k):
        lit = [v if isinstance(v, Column) else F.lit(v) for v in (up[k], down[k], mid[k], ("Neutral", 0.0, 0.5)[k])]
        return F.when(x.isNull(), lit[3]).when(x > up_at, lit[0]).when(x < down_at, lit[1]).otherwise(lit[2])
    return part(0), part(1), part(2)


def _spread(a: str, b: str) -> Column:
    return F.col(f"r_{a}") - F.col(f"r_{b}")


def xlu_canary(th: float = 0.005) -> Column:
    x = _spread("XLU", "SPY")
    conf = F.least(F.lit(0.9), F.abs(x) * 10 + 0.5)
    s = _three(x, th, -th, ("RiskOff", conf, F.when(x > 0.01, 0.8).otherwise(0.65)), ("RiskOn", conf, 0.7), ("Neutral", 0.3, 0.5))
    return _canary("XLUCanary", *s, 0.72, 1.0, F.coalesce(x, F.lit(0.0)))


def qqq_canary(th: float = 0.005) -> Column:
    x = _spread("QQQ", "SPY")
    conf = F.least(F.lit(0.9), F.abs(x) * 8 + 0.5)
    s = _three(x, th, -th, ("RiskOn", conf, 0.75), ("RiskOff", conf, 0.65), ("Neutral", 0.3, 0.5))
    return _canary("QQQCanary", *s, 0.70, 1.0, F.coalesce(x, F.lit(0.0)))


def credit_canary(th: float = -0.012) -> Column:
    x = _spread("HYG", "IEF")
    s = _three(x, 0.01, th, ("RiskOn", 0.75, 0.75), ("RiskOff", 0.85, 0.85), ("Neutral", 0.4, 0.5))
    return _canary("CreditSpreadCanary", *s, 0.78, 1.2, F.coalesce(x, F.lit(0.0)))


def consumer_canary(th: float = 0.005) -> Column:
    x = _spread("XLY", "XLP")
    s = _three(x, th, -th, ("RiskOn", 0.7, 0.7), ("RiskOff", 0.7, 0.7), ("Neutral", 0.3, 0.5))
    return _canary("ConsumerCanary", *s, 0.69, 1.0, F.coalesce(x, F.lit(0.0)))


def vix_canary(on: float = 18, off: float = 25, swan: float = 30) -> Column:
    v = F.col("vix")

    def part(*vals):
        a, b, c, d, e = [F.lit(x) for x in vals]
        return F.when(v.isNull(), e).when(v >= swan, a).when(v >= off, b).when(v <= on, c).otherwise(d)
    return _canary("VIXCanary", part("BlackSwan", "RiskOff", "RiskOn", "Neutral", "Neutral"),
                   part(0.95, 0.8, 0.75, 0.4, 0.0), part(0.9, 0.75, 0.7, 0.5, 0.5), 0.82, 1.5, F.coalesce(v, F.lit(0.0)))


def yield_canary() -> Column:
    x = _spread("TLT", "IEF")
    s = _three(x, 0.01, -0.01, ("RiskOff", 0.65, 0.65), ("RiskOn", 0.6, 0.6), ("Neutral", 0.3, 0.5))
    return _canary("YieldCurveCanary", *s, 0.66, 1.0, F.coalesce(x, F.lit(0.0)))


def dollar_canary() -> Column:
    x = _spread("UUP", "SPY")
    s = _three(x, 0.01, -0.01, ("RiskOff", 0.6, 0.6), ("RiskOn", 0.55, 0.55), ("Neutral", 0.3, 0.5))
    return _canary("DollarCanary", *s, 0.62, 0.8, F.coalesce(x, F.lit(0.0)))


def oil_canary() -> Column:
    x = _spread("XLE", "SPY")
    s = _three(x, 0.015, -0.015, ("Inflation", 0.7, 0.7), ("Deflation", 0.6, 0.6), ("Neutral", 0.3, 0.5))
    return _canary("OilCanary", *s, 0.67, 1.0, F.coalesce(x, F.lit(0.0)))


def gold_canary() -> Column:
    x = _spread("GLD", "SPY")
    s = _three(x, 0.015, -0.015, ("SafeHaven", 0.7, 0.7), ("RiskOn", 0.6, 0.6), ("Neutral", 0.3, 0.5))
    return _canary("GoldCanary", *s, 0.68, 1.0, F.coalesce(x, F.lit(0.0)))


# name -> struct expression over the wide inputs: the canary catalogue
CANARIES = {
    "XLUCanary": xlu_canary, "QQQCanary": qqq_canary, "CreditSpreadCanary": credit_canary,
    "ConsumerCanary": consumer_canary, "VIXCanary": vix_canary, "YieldCurveCanary": yield_canary,
    "DollarCanary": dollar_canary, "OilCanary": oil_canary, "GoldCanary": gold_canary,
}


def canaries(wide: DataFrame, names: list[str] | None = None, extra: tuple[Column, ...] = (), settings: DataFrame | None = None) -> DataFrame:
    """Long canary table: one row per (ts, canary).

    ``extra`` holds canaries of the user's own, each a ``spread_canary`` or a struct of the
    same fields. ``settings`` is described at ``configure``.
    """
    rows = F.array(*[CANARIES[n]() for n in (CANARIES if names is None else names)], *extra)
    return configure(wide.select("ts", F.inline(rows)), settings, "name")


def spread_canary(name: str, a: str, b: str, threshold: float, up: str = "RiskOn", down: str = "RiskOff", confidence: float = 0.7,
                  accuracy: float = 0.65, weight: float = 1.0) -> Column:
    """A canary on the difference of two symbols' 20-bar returns."""
    x = _spread(a, b)
    s = _three(x, threshold, -threshold, (up, confidence, confidence), (down, confidence, confidence), ("Neutral", 0.3, 0.5))
    return _canary(name, *s, accuracy, weight, F.coalesce(x, F.lit(0.0)))


def configure(rows: DataFrame, settings: DataFrame | None, name: str) -> DataFrame:
    """Rows of enabled canaries or layers with the weights of ``settings(name, enabled, weight)``.

    What the table does not mention, or leaves NULL, stays as built in.
    """
    if settings is None:
        return rows
    own = settings.select(F.col("name").alias(name), F.col("enabled").alias("_on"), F.col("weight").alias("_w"))
    df = rows.join(own, name, "left").where(F.coalesce("_on", F.lit(True)))
    return df.withColumn("weight", F.coalesce("_w", "weight")).select(*rows.columns)


def vote(canary: DataFrame) -> DataFrame:
    """Confidence-weighted vote of the canaries and its decision list."""
    c = F.col
    w = c("confidence") * c("weight") * c("accuracy")

    def score(*signals):
        return F.coalesce(F.sum(F.when(c("signal").isin(*signals), w)), F.lit(0.0))

    def fires(name, signal):
        return F.max((c("name") == name) & (c("signal") == signal))
    g = canary.groupBy("ts").agg(
        score("RiskOn").alias("risk_on"), score("RiskOff", "Defensive").alias("risk_off"),
        (score("BlackSwan") * 2).alias("black_swan"), score("Inflation", "SafeHaven").alias("inflation"),
        F.max((c("signal") == "BlackSwan") & (c("confidence") > 0.8)).alias("_swan"),
        fires("CreditSpreadCanary", "RiskOff").alias("_credit"), fires("XLUCanary", "RiskOff").alias("_xlu"),
        fires("ConsumerCanary", "RiskOff").alias("_consumer"),
        F.max((c("name") == "VIXCanary") & (c("signal") == "Neutral") & (c("value") >= 18) & (c("value") < 25)).alias("_range"))
    one = F.lit(1.0)
    steps = [
        ((c("black_swan") > 0.5) | c("_swan"), "BLACK_SWAN_VOL_SHOCK", F.least(one, c("black_swan")), 0.9),
        ((c("risk_off") > 1.0) & c("_credit"), "CREDIT_STRESS", F.least(one, c("risk_off") / 2), 0.8),
        (c("_xlu") & c("_consumer"), "DEFENSIVE_ROTATION", F.lit(0.75), 0.7),
        (c("_range"), "RANGE_BOUND_WHIPSAW", F.lit(0.65), 0.6),
        (c("inflation") > 0.6, "INFLATION_GROWTH", F.least(one, c("inflation")), 0.7),
        (c("risk_on") >= c("risk_off"), "RISK_ON_GROWTH", F.least(one, c("risk_on") / 3 + 0.5), 0.7),
    ]

    def pick(k, last):
        out = F.when(steps[0][0], _lit(steps[0][k]))
        for s in steps[1:]:
            out = out.when(s[0], _lit(s[k]))
        return out.otherwise(_lit(last))
    return g.select("ts", pick(1, "DEFENSIVE_ROTATION").alias("regime"), pick(2, 0.6).alias("confidence"),
                    pick(3, 0.6).alias("probability"), "risk_on", "risk_off", "black_swan", "inflation")


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ---------------------------------------------------------------- expert system

def holds(actual_text: Column, actual_number: Column, op: Column, expected: Column) -> Column:
    """Evaluate ``actual <op> expected`` with op as data; lists are '|' separated."""
    num = expected.try_cast("double")
    member = F.array_contains(F.split(expected, "\\|"), actual_text)
    return F.coalesce(
        F.when(op == "==", actual_text == expected).when(op == "!=", actual_text != expected)
        .when(op == ">", actual_number > num).when(op == "<", actual_number < num)
        .when(op == ">=", actual_number >= num).when(op == "<=", actual_number <= num)
        .when(op == "in", member).when(op == "not_in", ~member), F.lit(False))


def condition_table(canary: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row per (ts, rule, condition) with its truth.

    ``conditions(rule, canary, field, op, expected)``; a canary without a row
    makes its condition false.
    """
    grid = expand(canary.select("ts").distinct(), conditions)
    facts = canary.select("ts", F.col("name").alias("canary"), "signal", "value", "confidence", "probability")
    df = grid.join(facts, ["ts", "canary"], "left")
    field = F.col("field")
    text = F.when(field == "signal", F.col("signal")).when(field == "name", F.col("canary"))
    number = F.when(field == "value", F.col("value")).when(field == "confidence", F.col("confidence")).when(
        field == "probability", F.col("probability"))
    met = holds(F.coalesce(text, number.cast("string")), number, F.col("op"), F.col("expected"))
    return df.select("ts", "rule", "canary", "field", "op", "expected", met.alias("met"))


def default_rules(spark) -> tuple[DataFrame, DataFrame]:
    return (dims.frame(spark, dims.RULES, "rule string, regime string, confidence double, priority int, logic string"),
            dims.frame(spark, dims.RULE_CONDITIONS, "rule string, canary string, field string, op string, expected string"))


def fired_rules(canary: DataFrame, rules: DataFrame, conditions: DataFrame) -> DataFrame:
    t = condition_table(canary, conditions).groupBy("ts", "rule").agg(F.bool_and("met").alias("_all"), F.bool_or("met").alias("_any"))
    df = t.join(rules, "rule")
    return df.where(F.when(F.col("logic") == "AND", F.col("_all")).otherwise(F.col("_any"))).drop("_all", "_any")


def vote_counts(canary: DataFrame) -> DataFrame:
    """Votes of every signal per date, with the winner marked as in ``majority_signal``."""
    n = canary.groupBy("ts", "signal").agg(F.count(F.lit(1)).alias("votes"), F.min("name").alias("_first"))
    best = Window.partitionBy("ts").orderBy(F.desc("votes"), "_first")  # a date has a handful of signals
    return n.withColumn("winner", F.row_number().over(best) == 1).drop("_first")


def majority_signal(canary: DataFrame) -> DataFrame:
    """Most frequent signal per date; a tie goes to the signal of the first canary by name."""
    n = canary.groupBy("ts", "signal").agg(F.count(F.lit(1)).alias("votes"), F.min("name").alias("_first"))
    return n.groupBy("ts").agg(F.min_by("signal", F.struct(-F.col("votes"), F.col("_first"))).alias("signal"),
                               F.max("votes").alias("votes"))


def expert_system(canary: DataFrame, rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """Highest-priority fired rule per date, majority signal as fallback."""
    canary = cut(canary)
    spark = canary.sparkSession
    fired = fired_rules(canary, rules, conditions).groupBy("ts").agg(
        F.max_by(F.struct("rule", "regime", "confidence"), "priority").alias("_top"), F.count(F.lit(1)).alias("fired_count"))
    back = dims.frame(spark, dims.SIGNAL_TO_REGIME, "signal string, _fallback string")
    base = majority_signal(canary).join(F.broadcast(back), "signal", "left").join(fired, "ts", "left")
    return base.select(
        "ts", F.col("_top.rule").alias("rule"),
        F.coalesce(F.col("_top.regime"), F.col("_fallback"), F.lit("RISK_ON_GROWTH")).alias("final_regime"),
        F.coalesce(F.col("_top.confidence"), F.lit(0.5)).alias("confidence"),
        F.coalesce(F.col("fired_count"), F.lit(0)).alias("fired_count"))


# ---------------------------------------------------------------------- layers

def _layer(name: str, weight: float, x: Column, cases: list, last: tuple, value: Column | None = None) -> Column:
    """cases: (condition, regime, probability, confidence, duration, hit rate); first match wins."""
    def part(k):
        out = None
        for c in cases:
            out = F.when(c[0], _lit(c[k + 1])) if out is None else out.when(c[0], _lit(c[k + 1]))
        return out.otherwise(_lit(last[k]))
    return F.struct(
        F.lit(name).alias("layer"), part(0).alias("regime"), clip(part(1), 0, 1).alias("probability"),
        clip(part(2), 0, 1).alias("confidence"), part(3).cast("int").alias("expected_duration_days"),
        part(4).cast("double").alias("hit_rate"), F.lit(weight).alias("weight"), (x if value is None else value).alias("value"))


def _score(*terms: tuple[str, str, float]) -> Column:
    """Weighted sum of return spreads; a spread counts when both symbols are listed."""
    out = F.lit(0.0)
    for a, b, w in terms:
        out = out + F.when(F.col(f"has_{a}") & F.col(f"has_{b}"), (_r(a) - _r(b)) * w).otherwise(0.0)
    return out


def macro_layer() -> Column:
    x = _score(("XLI", "XLU", 1.0), ("IWM", "SPY", 0.8), ("XLB", "GLD", 0.6))
    p, c = F.least(F.lit(0.9), F.abs(x) * 10 + 0.6), F.least(F.lit(0.9), F.abs(x) * 8 + 0.5)
    return _layer("MacroRegime", 1.2, x, [(x > 0.015, "Expansion", p, c, 120, 0.68), (x < -0.015, "Contraction", p, c, 90, 0.68)],
                  ("Neutral", 0.55, 0.4, 45, 0.68))


def volatility_layer() -> Column:
    v = F.col("vix")
    return _layer("VolatilityRegime", 1.5, v, [
        (v.isNull(), "Normal", 0.5, 0.0, 30, 0.75), (v >= 30, "BlackSwan", 0.95, 0.9, 7, 0.85),
        (v >= 25, "HighVol", 0.8, 0.75, 15, 0.78), (v >= 18, "NormalVol", 0.6, 0.5, 30, 0.65)],
        ("LowVol", 0.75, 0.7, 60, 0.72), F.coalesce(v, F.lit(0.0)))


def trend_layer(min_bars: int = 210) -> Column:
    price, fast, slow = F.col("spy_price"), F.col("spy_ema50"), F.col("spy_ema200")
    short = F.coalesce(F.col("spy_bars") < min_bars, F.lit(True))
    away = F.try_divide(price, slow) - 1
    p, c = F.least(F.lit(0.9), F.abs(away) * 5 + 0.6), F.least(F.lit(0.85), F.abs(away) * 4 + 0.5)
    up, down = (price > slow) & (fast > slow), (price < slow) & (fast < slow)
    value = F.when(short, 0.0).when(up | down, away).otherwise(0.0)
    return _layer("TrendRegime", 1.2, value, [
        (short, "Sideways", 0.5, 0.0, 20, 0.60), (up, "Uptrend", p, c, 120, 0.70), (down, "Downtrend", p, c, 60, 0.68)],
        ("Sideways", 0.55, 0.4, 30, 0.60))


def liquidity_layer() -> Column:
    x = _score(("HYG", "IEF", 1.0), ("IWM", "SPY", 0.8))
    p = F.least(F.lit(0.85), F.abs(x) * 10 + 0.6)
    return _layer("LiquidityRegime", 1.0, x, [(x > 0.01, "HighLiquidity", p, 0.7, 90, 0.65), (x < -0.01, "LowLiquidity", p, 0.75, 30, 0.72)],
                  ("NeutralLiquidity", 0.5, 0.4, 45, 0.60))


def credit_layer() -> Column:
    x = _score(("HYG", "IEF", 1.0), ("LQD", "TLT", 0.7))
    return _layer("CreditRegime", 1.3, x, [
        (x < -0.02, "CreditStress", 0.9, 0.85, 20, 0.78), (x < -0.005, "CreditRiskOff", 0.7, 0.65, 40, 0.70),
        (x > 0.01, "CreditRiskOn", 0.75, 0.7, 90, 0.72)], ("CreditNeutral", 0.5, 0.4, 60, 0.60))


def inflation_layer() -> Column:
    x = _score(("TIP", "IEF", 1.2), ("XLE", "XLU", 0.8), ("GLD", "TLT", 0.5))
    return _layer("InflationRegime", 1.1, x, [(x > 0.015, "HighInflation", 0.75, 0.7, 180, 0.65), (x < -0.015, "LowInflation", 0.7, 0.65, 120, 0.62)],
                  ("NeutralInflation", 0.5, 0.4, 90, 0.58))


def dollar_layer() -> Column:
    x = _score(("UUP", "SPY", 1.0), ("UUP", "GLD", 0.5))
    return _layer("DollarRegime", 0.9, x, [(x > 0.01, "DollarStrength", 0.7, 0.65, 60, 0.64), (x < -0.01, "DollarWeakness", 0.7, 0.65, 60, 0.64)],
                  ("DollarNeutral", 0.5, 0.4, 45, 0.58))


LAYERS = {"MacroRegime": macro_layer, "VolatilityRegime": volatility_layer, "TrendRegime": trend_layer,
          "LiquidityRegime": liquidity_layer, "CreditRegime": credit_layer, "InflationRegime": inflation_layer,
          "DollarRegime": dollar_layer}


def layers(wide: DataFrame, names: list[str] | None = None, settings: DataFrame | None = None) -> DataFrame:
    """Long layer table: one row per (ts, layer); ``settings`` as for ``configure``."""
    return configure(wide.select("ts", F.inline(F.array(*[LAYERS[n]() for n in (names or LAYERS)]))), settings, "layer")


# fixed values: layer regimes counted as risk-on and risk-off
RISK_ON = ("Expansion", "LowVol", "Uptrend", "HighLiquidity", "CreditRiskOn", "DollarWeakness")
RISK_OFF = ("Contraction", "HighVol", "Downtrend", "LowLiquidity", "CreditRiskOff", "CreditStress", "DollarStrength")


def meta_regime(layer: DataFrame) -> DataFrame:
    """Combine the layers per date: weighted scores, decision list, contributions, duration."""
    c = F.col
    w = c("weight") * c("confidence") * c("hit_rate")

    def score(*names):
        return F.coalesce(F.sum(F.when(c("regime").isin(*names), w)), F.lit(0.0))
    g = layer.groupBy("ts").agg(
        score(*RISK_ON).alias("risk_on"), score(*RISK_OFF).alias("risk_off"), score("HighInflation").alias("inflation"),
        (score("BlackSwan") * 2).alias("black_swan"), F.sum(w).alias("_total"),
        F.max((c("layer") == "CreditRegime") & (c("regime") == "CreditStress")).alias("_stress"),
        F.sum(w * c("expected_duration_days")).alias("_days"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", w.alias("w"))))).alias("_parts"))
    one, on, off = F.lit(1.0), c("risk_on"), c("risk_off")
    steps = [
        (c("black_swan") > 0.5, "BLACK_SWAN_VOL_SHOCK", F.least(one, c("black_swan") + 0.6), F.least(one, c("black_swan") + 0.5)),
        ((off > 1.5) & c("_stress"), "CREDIT_STRESS", 0.85, 0.8),
        (off > 1.5, "DEFENSIVE_ROTATION", 0.7, 0.65),
        (c("inflation") > 0.6, "INFLATION_GROWTH", 0.7, 0.65),
        (on >= off, "RISK_ON_GROWTH", F.least(one, on / 3 + 0.5), F.least(one, on / 4 + 0.5)),
    ]

    def pick(k, last):
        out = F.when(steps[0][0], _lit(steps[0][k]))
        for s in steps[1:]:
            out = out.when(s[0], _lit(s[k]))
        return out.otherwise(_lit(last))
    share = F.transform_values("_parts", lambda _k, v: F.round(F.coalesce(F.try_divide(v, c("_total")), F.lit(0.0)), 4))
    return g.select(
        "ts", pick(1, "RANGE_BOUND_WHIPSAW").alias("final_regime"), clip(pick(2, 0.55), 0, 1).alias("probability"),
        clip(pick(3, 0.5), 0, 1).alias("confidence"),
        F.coalesce(F.floor(F.round(F.try_divide("_days", "_total"), 9)), F.lit(30)).cast("int").alias("expected_duration_days"),
        "risk_on", "risk_off", "inflation", "black_swan", share.alias("contributions"))
