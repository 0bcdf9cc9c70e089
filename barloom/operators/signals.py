"""Crossover signals, the screener, signal combination and rule signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.scalars import change, crossed_down, crossed_up, truth
from barloom.operators import features as feat
from barloom.operators.timeline import ema_blocks, ema_input, emas, index_bars, linear_scan, own, pick, scan, window
from barloom.session import cut


@dataclass(frozen=True)
class TripleEma:
    """Spans of the triple EMA plus MACD signal."""
    fast: int = 5
    mid: int = 50
    slow: int = 222
    macd_fast: int = 61
    macd_slow: int = 70
    macd_signal: int = 15


DEFAULT = TripleEma()
BITCOIN = TripleEma(5, 64, 170, 32, 40, 94)

# fixed values: trigger texts shown by the screener, up and down crossings in report order
TRIGGERS = (
    ("delta_up", "MACD Hist >0 Cross"), ("delta_down", "MACD Hist <0 CrossUnder"),
    ("e12_up", "EMA5>EMA50 Cross"), ("e12_down", "EMA5<EMA50 CrossUnder"),
    ("e13_up", "EMA5>EMA222 Cross"), ("e13_down", "EMA5<EMA222 CrossUnder"),
    ("e23_up", "EMA50>EMA222 Cross"), ("e23_down", "EMA50<EMA222 CrossUnder"),
)


def _temacd_blocks(bars: DataFrame, p: TripleEma, warmup: bool) -> DataFrame:
    """EMA, MACD and delta columns on 256-row blocks with one leading row."""
    close = F.col("close")
    df = emas(ema_blocks(bars.where(close.isNotNull())), {
        "ema1": (close, p.fast), "ema2": (close, p.mid), "ema3": (close, p.slow),
        "_mf": (close, p.macd_fast), "_ms": (close, p.macd_slow)}, warmup)
    df = df.withColumn("macd", F.col("_mf") - F.col("_ms")).drop("_mf", "_ms")
    start = max(p.macd_fast, p.macd_slow) - 1 if warmup else 0
    df = linear_scan(df, {"amacd": ema_input(F.col("macd"), p.macd_signal, start)})
    shown = start + (p.macd_signal - 1 if warmup else 0)
    df = df.withColumn("amacd", F.when(F.col("_i") >= shown, F.col("amacd")))
    return df.withColumn("delta", F.col("macd") - F.col("amacd"))


# recurrences behind the columns above, as they are carried from bar to bar
CARRIED = ("ema1", "ema2", "ema3", "macd_fast", "macd_slow", "amacd")


def temacd_step(bars: DataFrame, state: DataFrame, p: TripleEma = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Conditions of new bars given the state of each symbol's last bar, and the state after them.

    ``bars(symbol, ts, close)`` follow the bars behind ``state(symbol, ts, _i,
    close, carried)``, whose struct ``carried`` holds the recurrences at that bar; the
    history itself is not needed. A state row enters the block scan as the bar it
    stands for, with its values as input, so any number of new bars, also a
    first load of whole histories, is worked on in blocks. The result has ``_i``,
    the columns of ``temacd_conditions`` and ``prev_close``; the second frame has the new
    states of the symbols in ``bars``.
    """
    new = scan(bars.where(F.col("close").isNotNull()).select("symbol", "ts", "close"), {"_k": ("count", F.lit(1))})
    known = state.join(bars.select("symbol").distinct(), "symbol", "left_semi")
    at = known.select("symbol", (F.col("_i") + 1).alias("_from"))
    new = new.join(at, "symbol", "left").withColumn("_i", F.coalesce("_from", F.lit(0)) + F.col("_k") - 1).drop("_from", "_k")
    df = ema_blocks(new.unionByName(known, allowMissingColumns=True))
    start = max(p.macd_fast, p.macd_slow) - 1
    spans = {"ema1": p.fast, "ema2": p.mid, "ema3": p.slow, "macd_fast": p.macd_fast, "macd_slow": p.macd_slow}

    def seeded(df: DataFrame, x: Column, spans: dict[str, int], start: int) -> DataFrame:
        inputs = {n: ema_input(x, span, start) for n, span in spans.items()}
        df = linear_scan(df, {f"_{n}": (F.coalesce(F.col(f"carried.{n}"), u), beta) for n, (u, beta) in inputs.items()})
        exact = {n: F.when(F.col("_i") == start, x) for n in spans}  # seeds and states are free of rounding
        return df.withColumns({f"_{n}": F.coalesce(F.col(f"carried.{n}"), e, F.col(f"_{n}")) for n, e in exact.items()})

    df = seeded(df, F.col("close"), spans, 0)
    df = df.withColumn("macd", F.col("_macd_fast") - F.col("_macd_slow"))
    df = seeded(df, F.col("macd"), {"amacd": p.macd_signal}, start)
    shown = {"ema1": p.fast - 1, "ema2": p.mid - 1, "ema3": p.slow - 1, "amacd": start + p.macd_signal - 1}
    df = df.withColumns({n: F.when(F.col("_i") >= first, F.col(f"_{n}")) for n, first in shown.items()})
    df = df.withColumn("delta", F.col("macd") - F.col("amacd"))
    df = own(_crossings(df).withColumn("prev_close", F.lag("close").over(window())), drop_index=False)
    df = cut(df.withColumn("_old", F.col("carried").isNotNull()).withColumn("carried", F.struct(*[F.col(f"_{n}").alias(n) for n in CARRIED])))
    return df.where("NOT _old").drop("_old", "carried", *[f"_{n}" for n in CARRIED]), last_row(df.select("symbol", "ts", "_i", "close", "carried"), order="_i")


def _crossings(df: DataFrame) -> DataFrame:
    w = window()

    def pair(a, b):
        now = (F.col(a), F.col(b))
        before = (F.lag(a).over(w), F.lag(b).over(w))
        return crossed_up(*now, *before), crossed_down(*now, *before)

    zero, d, dp = F.lit(0.0), F.col("delta"), F.lag("delta").over(w)
    out = {"delta_up": crossed_up(d, zero, dp, zero), "delta_down": crossed_down(d, zero, dp, zero)}
    for tag, a, b in (("e12", "ema1", "ema2"), ("e13", "ema1", "ema3"), ("e23", "ema2", "ema3")):
        out[f"{tag}_up"], out[f"{tag}_down"] = pair(a, b)
    df = df.withColumns(out)
    up = [F.col(k) for k in out if k.endswith("_up")]
    down = [F.col(k) for k in out if k.endswith("_down")]
    return df.withColumns({"long": up[0] | up[1] | up[2] | up[3],
                           "short": down[0] | down[1] | down[2] | down[3]})


def temacd(bars: DataFrame, p: TripleEma = DEFAULT, warmup: bool = True) -> DataFrame:
    """symbol, ts, close with ema1..3, macd, amacd, delta."""
    return own(_temacd_blocks(pick(bars, "close"), p, warmup))


def temacd_conditions(bars: DataFrame, p: TripleEma = DEFAULT, warmup: bool = True) -> DataFrame:
    """temacd() plus the eight crossings and the long/short conditions."""
    return own(_crossings(_temacd_blocks(pick(bars, "close"), p, warmup)))


def signal_table(conds: DataFrame, precedence: str = "short", name: str = "TQQQ_TEMACD") -> DataFrame:
    """signals(symbol, ts, strategy, signal, confidence) from long/short flags.

    ``precedence`` decides a bar on which both fire.
    """
    first, second = ("long", "short") if precedence == "long" else ("short", "long")
    value = {"long": F.lit(1), "short": F.lit(-1)}
    signal = F.when(F.col(first), value[first]).when(F.col(second), value[second]).otherwise(0)
    return conds.select("symbol", "ts", F.lit(name).alias("strategy"), signal.alias("signal")).withColumn(
        "confidence", F.when(F.col("signal") != 0, 0.9).otherwise(0.8))


def trend_label(e1: Column, e2: Column, e3: Column, neutral: bool = True) -> Column:
    """Label from the EMA order; without ``neutral`` ties fall to the bear side."""
    label = F.when((e1 > e2) & (e2 > e3), "STRONG BULL").when(e1 > e2, "BULLISH")
    if not neutral:
        return label.when((e1 < e2) & (e2 < e3), "STRONG BEAR").otherwise("BEARISH")
    return label.when((e1 < e2) & (e2 < e3), "STRONG BEAR").when(e1 < e2, "BEARISH").otherwise("NEUTRAL/ROTATION")


def trigger_array() -> Column:
    names = F.array_compact(F.array(*[F.when(F.col(c), F.lit(text)) for c, text in TRIGGERS]))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("-")))


def last_row(df: DataFrame, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Newest row per key, combined map-side."""
    cols = [c for c in df.columns if c != key]
    top = df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_s"))
    return top.select(key, *[F.col(f"_s.{c}").alias(c) for c in cols])


def screener(bars: DataFrame, p: TripleEma = DEFAULT, min_bars: int = 250) -> DataFrame:
    """One row per symbol with the decision on its last bar.

    Symbols with fewer than ``min_bars`` bars or an undefined slow EMA are absent.
    """
    df = _crossings(_temacd_blocks(pick(bars, "close"), p, True))
    df = df.withColumn("prev_close", F.lag("close").over(window()))
    last = last_row(own(df, drop_index=False))
    last = last.where(complete(min_bars))
    return last.select(
        "symbol", F.col("ts").cast("date").alias("date"), "close", "prev_close",
        F.coalesce(change(F.col("close"), F.col("prev_close")) * 100, F.lit(0.0)).alias("chg_pct"),
        "ema1", "ema2", "ema3", "delta", "macd", "amacd", "long", "short",
        decision().alias("signal"), trend_label(F.col("ema1"), F.col("ema2"), F.col("ema3")).alias("trend"),
        trigger_array().alias("triggers"))


def complete(min_bars: int) -> Column:
    """A bar with enough history for a decision."""
    return (F.col("_i") >= min_bars - 1) & F.col("ema3").isNotNull() & F.col("delta").isNotNull()


def decision() -> Column:
    return F.when(F.col("long"), "LONG ENTRY").when(F.col("short"), "SHORT/EXIT").otherwise("HOLD")


def signal_order() -> Column:
    return F.when(F.col("signal") == "LONG ENTRY", 0).when(F.col("signal") == "SHORT/EXIT", 1).when(
        F.col("signal") == "HOLD", 2).otherwise(3)


def signal_counts(screen: DataFrame) -> DataFrame:
    return screen.agg(
        F.count_if(F.col("signal") == "LONG ENTRY").alias("long_entries"),
        F.count_if(F.col("signal") == "SHORT/EXIT").alias("short_exits"),
        F.count_if(F.col("signal") == "HOLD").alias("holds"),
        F.count_if(F.col("trend").contains("STRONG BULL")).alias("strong_bulls"))


def direction_gate(df: DataFrame, start: str | None = None, end: str | None = None,
                   direction: str = "both") -> DataFrame:
    """Mask long/short flags by trade direction and an inclusive date range."""
    inside = F.lit(True)
    if start:
        inside = inside & (F.col("ts") >= F.lit(start).cast("date"))
    if end:
        inside = inside & (F.col("ts") <= F.lit(end).cast("date"))
    return df.withColumns({
        "long": truth(F.col("long") & inside & F.lit(direction in ("both", "long"))),
        "short": truth(F.col("short") & inside & F.lit(direction in ("both", "short")))})


# ------------------------------------------------------------ other strategies

def _ema_pair(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    df = emas(ema_blocks(bars), {"fast": (F.col("close"), fast), "slow": (F.col("close"), slow)}, True)
    w = window()
    f, s = F.col("fast"), F.col("slow")
    fp, sp = F.lag("fast").over(w), F.lag("slow").over(w)
    return df.withColumns({"up": crossed_up(f, s, fp, sp), "down": crossed_down(f, s, fp, sp)})


def ma_cross(bars: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """Long on an up cross above the slow EMA; out on a down cross or a close below it."""
    df = _ema_pair(pick(bars, "close"), fast, slow)
    return own(df).select("symbol", "ts", "close",
                          truth(F.col("up") & (F.col("close") > F.col("slow"))).alias("long"),
                          truth(F.col("down") | (F.col("close") < F.col("slow"))).alias("short"))


def ema_cross(bars: DataFrame, fast: int = 10, slow: int = 40) -> DataFrame:
    """Plain double EMA cross."""
    df = own(_ema_pair(pick(bars, "close"), fast, slow))
    return df.select("symbol", "ts", "close", F.col("up").alias("long"), F.col("down").alias("short"))


def donchian_trend(bars: DataFrame, entry: int = 20, exit: int = 10, fast: int = 32, slow: int = 128) -> DataFrame:
    """Breakout above the channel with the trend; out below it or against the trend."""
    chan = feat.compute(pick(bars, "high", "low", "close"),
                        {"don": feat.donchian(entry, exit)}, keep_index=True)
    df = own(emas(ema_blocks(chan), {"fast": (F.col("close"), fast), "slow": (F.col("close"), slow)}, True))
    return df.select(
        "symbol", "ts", "close",
        truth((F.col("close") > F.col("don_upper")) & (F.col("fast") > F.col("slow"))).alias("long"),
        F.coalesce(F.col("close") < F.col("don_lower"), F.lit(False)).alias("_below"), "fast", "slow",
    ).withColumn("short", F.col("_below") | truth(F.col("fast") < F.col("slow"))).drop("_below", "fast", "slow")


def momentum_rule(bars: DataFrame) -> DataFrame:
    """12-1 momentum above 10 % over the EMA200; out below zero or under the EMA200."""
    df = feat.compute(pick(bars, "close"), {
        "m12": feat.momentum(252), "m1": feat.momentum(21)}, keep_index=True)
    df = own(emas(ema_blocks(df), {"e200": (F.col("close"), 200)}))
    m = (F.col("m12") + 1) - (F.col("m1") + 1)
    return df.select("symbol", "ts", "close",
                     truth((m > 0.1) & (F.col("close") > F.col("e200"))).alias("long"),
                     truth((m < 0) | (F.col("close") < F.col("e200"))).alias("short"))


def trend_rule(bars: DataFrame, min_volume: float = 500000.0) -> DataFrame:
    """Close over EMA50, RSI14 under 70 and volume; out under EMA50 or RSI over 80."""
    df = feat.compute(pick(bars, "close", "volume"), {"rsi": feat.rsi(14)}, keep_index=True)
    df = own(emas(ema_blocks(df), {"e50": (F.col("close"), 50)}))
    c, e, r = F.col("close"), F.col("e50"), F.col("rsi")
    return df.select("symbol", "ts", "close",
                     truth((c > e) & (r < 70) & (F.col("volume") > min_volume)).alias("long"),
                     truth((c < e) | (r > 80)).alias("short"))


def pair_ratio_rule(bars: DataFrame, first: str, second: str, span: int = 20) -> DataFrame:
    """Ratio of two symbols crossing its EMA: up is long the first, down is out."""
    b = bars.where(F.col("symbol") == second).select("ts", F.col("close").alias("_c2"))
    a = bars.where(F.col("symbol") == first).select("symbol", "ts", F.col("close").alias("_c1"))
    pair = a.join(b, "ts").select("symbol", "ts", F.try_divide("_c1", "_c2").alias("close"))
    df = emas(ema_blocks(index_bars(pair)), {"ma": (F.col("close"), span)})
    w = window()
    x, m, xp, mp = F.col("close"), F.col("ma"), F.lag("close").over(w), F.lag("ma").over(w)
    df = df.withColumns({"long": crossed_up(x, m, xp, mp), "short": crossed_down(x, m, xp, mp)})
    return own(df).select("symbol", "ts", "close", "long", "short")


# name -> bars to conditions(symbol, ts, close, long, short): the signal catalogue
REGISTRY = {
    "TQQQ_TEMACD": temacd_conditions,
    "BTC_TEMACD": lambda bars: temacd_conditions(bars, BITCOIN),
    "LT_MA_CROSS": ma_cross,
    "DONCHIAN_CARVER": donchian_trend,
    "EMA_CROSS_10_40": ema_cross,
}


def generate_all(bars: DataFrame, names: list[str] | None = None, precedence: str = "short") -> DataFrame:
    """Union of the registered signals for every symbol."""
    out = None
    for name in sorted(names or REGISTRY):
        one = signal_table(REGISTRY[name](bars), precedence, name)
        out = one if out is None else out.unionByName(one)
    return out


def combine(signals: DataFrame, method: str = "or") -> DataFrame:
    """Merge the strategies' signals per bar: or, and, majority."""
    pos, neg, n = F.count_if(F.col("signal") == 1), F.count_if(F.col("signal") == -1), F.count(F.lit(1))
    rules = {
        "or": F.when(pos > 0, 1).when(neg > 0, -1).otherwise(0),
        "and": F.when(pos == n, 1).when(neg == n, -1).otherwise(0),
        "majority": F.when(pos > neg, 1).when(neg > pos, -1).otherwise(0),
    }
    if method not in rules:
        raise ValueError("method must be or, and or majority")
    return signals.groupBy("symbol", "ts").agg(rules[method].alias("signal")).withColumn("confidence", F.lit(0.8))
