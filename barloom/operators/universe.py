"""Point-in-time universes: filters as columns, evaluated as of many dates at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.scalars import ratio
from barloom.operators import features as feat
from barloom.operators.joins import asof_backward
from barloom.operators.timeline import attach, blocks, index_bars, own, scan, window
from barloom.plans import dims
from barloom.session import cut

LEVERAGED = ("TQQQ", "UPRO", "SPXL")  # fixed values: symbols with the looser tracking proxy


@dataclass(frozen=True)
class Limits:
    min_history: int = 252
    grace_days: int = 30
    min_avg_volume: float = 100000.0
    min_notional: float = 1000000.0
    min_aum: float = 50000000.0
    max_spread: float = 0.01
    max_turnover: float = 5.0
    max_tracking_error: float = 0.05
    benchmark: str = "SPY"


FILTERS = ("Delisted", "MinimumHistory", "MinimumVolume", "MinimumAUM", "MaximumSpread", "MaximumTurnover", "TrackingError")


def liquidity_features(bars: DataFrame, n: int = 20, te_window: int = 60) -> DataFrame:
    """Per bar: history length, average volume and notional, spread, turnover, volatility."""
    bars = bars if "_i" in bars.columns else index_bars(bars)
    df = blocks(bars, max(2 * n, te_window + 1))
    w = window()
    df = df.withColumns({"_not": F.col("volume") * F.col("close"),
                         "_spr": ratio(F.col("high") - F.col("low"), F.col("close")),
                         "_ret": ratio(F.col("close"), F.col("_pc")) - 1})
    last, before = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-(2 * n - 1), -n)
    vol = F.stddev_samp("_ret").over(w.rowsBetween(-(te_window - 1), 0)) * feat.ANNUAL
    df = df.withColumns({
        "bars": F.col("_i") + 1,
        "avg_volume": F.when(F.col("_i") >= n - 1, F.avg("volume").over(last)),
        "avg_notional": F.when(F.col("_i") >= n - 1, F.avg("_not").over(last)),
        "spread": F.when(F.col("_i") >= n - 1, F.avg("_spr").over(last)),
        "turnover": F.when(F.col("_i") >= 2 * n - 1, F.coalesce(ratio(F.avg("volume").over(last), F.avg("volume").over(before)), F.lit(0.0))),
        "vol60": F.when(F.col("_i") >= te_window - 1, vol)})
    return own(df).select("symbol", "ts", "bars", "avg_volume", "avg_notional", "spread", "turnover", "vol60")


def as_of(symbols: DataFrame, dates: Column) -> DataFrame:
    """symbol x as-of date rows from an array expression of dates."""
    return symbols.select("symbol", F.explode(dates).alias("ts"))


def monthly_dates(start: str, end: str) -> Column:
    return F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))


def business_days(start: str, end: str) -> Column:
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return F.filter(days, lambda d: F.weekday(d) < 5)


def _life(bars: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """First and last bar of every symbol with its metadata, NULL where there is none."""
    life = bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    if metadata is not None:
        return cut(life.join(metadata.select("symbol", "listing", "delisting", "aum", "tracking_error"), "symbol", "left"))
    return cut(life.withColumns({"listing": F.lit(None).cast("date"), "delisting": F.lit(None).cast("date"),
                                 "aum": F.lit(None).cast("double"), "tracking_error": F.lit(None).cast("double")}))


def _judged(df: DataFrame, limits: Limits) -> DataFrame:
    """Values and verdicts of rows that hold an ``as_of`` date, the liquidity features known then and the symbol's life."""
    c = F.col
    n = F.coalesce(c("bars"), F.lit(0))
    listed = F.coalesce(c("listing"), c("first_ts"))
    lev = F.lit(False)
    for s in LEVERAGED:
        lev = lev | c("symbol").contains(s)
    te = F.coalesce(c("tracking_error"), c("vol60") * F.when(lev, 0.5).otherwise(0.3))
    aum = F.coalesce(c("aum"), c("avg_notional") * 100, F.lit(0.0))
    spread = F.coalesce(c("spread"), F.when(n >= 20, 0.0))
    return df.select(
        "as_of", "symbol", n.alias("history"), "avg_volume", "avg_notional", aum.alias("aum"), spread.alias("spread"),
        F.coalesce(c("turnover"), F.lit(0.0)).alias("turnover"), te.alias("tracking_error"),
        F.coalesce(c("as_of") < listed, F.lit(False)).alias("before_listing"),
        F.coalesce(c("as_of") > c("delisting"), F.lit(False)).alias("after_delisting"),
        (F.coalesce(c("delisting") > c("as_of"), F.lit(True)) & (F.date_add(c("last_ts"), limits.grace_days) >= c("as_of"))
         & (c("as_of") >= c("first_ts"))).alias("ok_Delisted"),
        (n >= limits.min_history).alias("ok_MinimumHistory"),
        F.coalesce((c("avg_volume") >= limits.min_avg_volume) & (c("avg_notional") >= limits.min_notional), F.lit(False)).alias("ok_MinimumVolume"),
        (aum >= limits.min_aum).alias("ok_MinimumAUM"),
        F.coalesce(spread <= limits.max_spread, F.lit(False)).alias("ok_MaximumSpread"),
        F.coalesce(c("turnover") <= limits.max_turnover, F.lit(True)).alias("ok_MaximumTurnover"),
        ((c("symbol") == limits.benchmark) | F.coalesce(te <= limits.max_tracking_error, F.lit(True))).alias("ok_TrackingError"),
        *[c(x) for x in ("first_ts", "last_ts", "listing", "delisting")])


def checks(bars: DataFrame, dates: Column | DataFrame, limits: Limits = Limits(), metadata: DataFrame | None = None) -> DataFrame:
    """All filter values and verdicts per (symbol, as-of date): the table asked for has a row for each.

    ``dates`` is an array expression or a one-column frame ``ts`` of dates.
    ``metadata(symbol, listing, delisting, aum, tracking_error)`` is optional;
    missing values fall back to proxies computed as of the date, tracking error
    is a fraction.
    """
    bars = bars if "_i" in bars.columns else index_bars(bars)
    life = _life(bars, metadata)
    if isinstance(dates, Column):
        asked = as_of(life.select("symbol"), dates)
    else:
        every = dates.agg(F.array_sort(F.collect_set("ts")).alias("_days"))
        asked = as_of(attach(life.select("symbol"), every), F.col("_days"))
    df = asof_backward(asked, liquidity_features(bars)).join(life, "symbol").withColumnRenamed("ts", "as_of")
    return _judged(df, limits)


# ------------------------------------------------------------ inclusion spans

def listed_spans(bars: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(symbol, since, until): the days between listing (first bar without one) and delisting, ``until`` NULL while listed."""
    return _life(bars, metadata).select("symbol", F.coalesce("listing", "first_ts").alias("since"), F.col("delisting").alias("until"))


def members_at(spans: DataFrame, dates: DataFrame, bucket_days: int = 512) -> DataFrame:
    """(as_of, symbol) of every date of ``dates(as_of)`` inside a span: an interval join by time bucket.

    A span is listed under the buckets it covers up to the newest date asked for,
    a date under its own, and both meet in an equi-join.
    """
    day = F.unix_date(F.col("as_of").cast("date"))
    newest = dates.agg(F.max(day).alias("_newest"))
    first = F.floor(F.unix_date("since") / bucket_days)
    last = F.floor(F.least(F.coalesce(F.unix_date("until"), F.col("_newest")), F.col("_newest")) / bucket_days)
    listed = attach(spans, newest).where(last >= first).select("symbol", "since", "until", F.explode(F.sequence(first, last)).alias("_k"))
    asked = dates.select("as_of", F.floor(day / bucket_days).alias("_k"))
    hit = (F.col("as_of") >= F.col("since")) & F.coalesce(F.col("as_of") <= F.col("until"), F.lit(True))
    return asked.join(listed, "_k").where(hit).select("as_of", "symbol")


def inclusion_spans(bars: DataFrame, limits: Limits = Limits(), metadata: DataFrame | None = None) -> DataFrame:
    """(symbol, since, until): the longest runs of days on which a symbol passes all filters.

    A verdict changes only with a bar or where a symbol's listed life begins or
    ends, so every bar is judged once and stands for the days up to the next one;
    neighbouring bars of one verdict form a span. No date is paired with a symbol
    that has no bar on it.
    """
    bars = bars if "_i" in bars.columns else index_bars(bars)
    rows = liquidity_features(bars).join(_life(bars, metadata), "symbol").withColumn("as_of", F.col("ts"))
    passed = F.lit(True)
    for f in FILTERS[1:]:  # being listed is a matter of days, not of bars
        passed = passed & F.col(f"ok_{f}")
    rows = _judged(rows, limits).select("symbol", F.col("as_of").alias("ts"), passed.alias("_in"), "first_ts", "last_ts", "listing", "delisting")
    rows = cut(scan(rows, {"_was": ("prev", F.col("_in")), "_next": ("next", F.col("ts"))}))
    rows = scan(rows.where("_in"), {"_run": ("count", F.when(F.coalesce(~F.col("_was"), F.lit(True)), 1))})
    last = F.coalesce(F.date_sub("_next", 1), F.date_add("last_ts", limits.grace_days))
    runs = rows.groupBy("symbol", "_run").agg(F.min("ts").alias("_a"), F.max(last).alias("_b"), *[F.first(x).alias(x) for x in ("listing", "delisting", "last_ts")])
    since, until = F.greatest("_a", "listing"), F.least("_b", F.date_sub("delisting", 1), F.date_add("last_ts", limits.grace_days))
    return runs.select("symbol", since.alias("since"), until.alias("until")).where("since <= until")


def size_over_time(spans: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of, size) for ``dates(as_of)``: spans that begin less spans that have ended, summed up over their borders."""
    steps = (spans.select(F.col("since").alias("ts"), F.lit(1).alias("_s"))
             .unionByName(spans.select(F.date_add("until", 1).alias("ts"), F.lit(-1).alias("_s"))).groupBy("ts").agg(F.sum("_s").alias("_s")))
    level = scan(cut(steps.withColumn("_g", F.lit(0))), {"size": ("sum", F.col("_s"))}, ("_g",)).select("_g", "ts", "size")
    asked = dates.select(F.lit(0).alias("_g"), F.col("as_of").alias("ts"))
    return asof_backward(asked, level, ("_g",)).select(F.col("ts").alias("as_of"), F.coalesce("size", F.lit(0)).alias("size"))


def snapshots(checked: DataFrame, enabled: tuple[str, ...] = FILTERS) -> DataFrame:
    """Universe per date: included flag and the first failed filter in the given order."""
    failed = F.coalesce(F.when(F.col("before_listing"), "BeforeIPO"), F.when(F.col("after_delisting"), "Delisted"),
                        *[F.when(~F.col(f"ok_{f}"), f) for f in enabled])
    return checked.select("as_of", "symbol", failed.isNull().alias("included"), failed.alias("failed_filter"))


def universe_size(snap: DataFrame) -> DataFrame:
    return snap.groupBy("as_of").agg(F.count_if("included").alias("size"))


def _cagr(curve: DataFrame, ret: str) -> DataFrame:
    """CAGR of the path measured from its first equity point, over calendar years."""
    g = curve.agg(F.product(F.lit(1.0) + F.col(ret)).alias("_p"), F.min_by(ret, "ts").alias("_r0"),
                  F.datediff(F.max("ts"), F.min("ts")).alias("_days"))
    growth = F.try_divide(F.col("_p"), F.lit(1.0) + F.col("_r0"))
    years = F.col("_days") / 365.25
    return g.select(F.when(years > 0, F.pow(growth, 1 / years) - 1).otherwise(0.0).alias(ret))


def survivorship_bias(rets: DataFrame, spans: DataFrame) -> DataFrame:
    """Static against point-in-time equal-weight CAGR with score and label.

    ``rets(symbol, ts, ret)``; ``spans(symbol, since, until)`` of inclusion. The
    static book divides by all symbols, a missing return counts as 0. The average
    size is that over all dates of the return table, the first ones without a
    return included.
    """
    rets, spans = cut(rets.select("symbol", "ts", "ret")), cut(spans)
    live = rets.where(F.col("ret").isNotNull())
    n = live.agg(F.countDistinct("symbol").alias("static_size"))
    starts = spans.select("symbol", F.col("since").alias("ts"), "until")
    known = asof_backward(live, starts).withColumn("_in", F.coalesce(F.col("ts") <= F.col("until"), F.lit(False)))
    day = known.groupBy("ts").agg(F.sum("ret").alias("_sum"), F.coalesce(F.avg(F.when(F.col("_in"), F.col("ret"))), F.lit(0.0)).alias("_dynamic"))
    day = cut(attach(day, n).select("ts", (F.col("_sum") / F.col("static_size")).alias("_static"), "_dynamic"))
    size = size_over_time(spans, rets.select(F.col("ts").alias("as_of")).distinct()).agg(F.avg("size").alias("dynamic_avg_size"))
    row = attach(attach(attach(n, size), _cagr(day, "_static")), _cagr(day, "_dynamic"))
    diff = (F.col("static_size") - F.col("dynamic_avg_size")) / F.col("static_size") * 100
    score = F.coalesce(F.try_divide(F.col("_static") - F.col("_dynamic"), F.abs("_dynamic")), F.lit(0.0)) * 100
    a = F.abs(score)
    label = F.when(a > 20, "very high").when(a > 10, "high").when(a > 5, "moderate").when(F.abs(diff) > 10, "high size bias").otherwise("low")
    return row.select("static_size", "dynamic_avg_size", diff.alias("size_diff_pct"), (F.col("_static") * 100).alias("static_cagr"),
                      (F.col("_dynamic") * 100).alias("dynamic_cagr"), score.alias("bias_score_pct"), label.alias("interpretation"))


# -------------------------------------------------------------- classification

def asset_class(symbol: Column, known: Column | None = None) -> Column:
    t = F.upper(symbol)
    return (F.when(t.contains("-USD"), "Crypto").when(t.contains("=F"), "Futures").when(t == "DBMF", "Managed Futures")
            .otherwise(F.coalesce(known if known is not None else F.lit(None).cast("string"), F.lit("Equity"))))


# fixed values: macro bucket, its symbols, words in the name of a sector that belongs to it; the first match counts
MACRO_BUCKETS = (
    ("Defensive", ("XLU", "XLP", "XLV", "BIL", "IEF"), ("utilities", "staples", "health")),
    ("Inflation", ("XLE", "XLB", "USO"), ("energy", "materials")),
    ("Safe Haven", ("GLD", "SLV", "TLT"), ("gold",)),
    ("Dollar", ("UUP",), ()), ("Fear", ("VIXY",), ()),
    ("Risk On", ("SVXY", "QQQ", "TQQQ", "XLK", "XLY", "BTC-USD", "MES=F", "SPY", "IWM"), ()),
    ("Credit", ("HYG", "LQD"), ()), ("Alternative", ("DBMF",), ()),
)
# fixed values: risk bucket, least absolute beta, least volatility in percent
RISK_BUCKETS = (("Very High", 3.0, 50.0), ("High", 1.3, 28.0), ("Medium", 0.8, 16.0))


def macro_bucket(symbol: Column, sector: Column, cls: Column) -> Column:
    t, s = F.upper(symbol), F.lower(F.coalesce(sector, F.lit("")))
    steps = [(reduce(Column.__or__, [s.contains(w) for w in words], t.isin(*symbols)), name) for name, symbols, words in MACRO_BUCKETS]
    steps.append((cls == "Crypto", "Risk On"))
    return F.coalesce(*[F.when(hit, name) for hit, name in steps], F.lit("Balanced"))


def risk_bucket(beta: Column, vol_pct: Column, cls: Column) -> Column:
    levels = [F.when((F.abs(beta) >= b) | (vol_pct >= v), name) for name, b, v in RISK_BUCKETS]
    return F.coalesce(F.when(cls == "Crypto", RISK_BUCKETS[0][0]), *levels, F.lit("Low"))


def known_assets(spark) -> DataFrame:
    return dims.frame(spark, dims.ASSETS, "symbol string, asset_class string, sector string, macro_bucket string, risk_bucket string, beta double")


def with_assets(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows per symbol with all columns of the asset table, defaults for symbols it does not have, and ``known``."""
    defaults = {"asset_class": "Equity", "sector": "Unknown", "macro_bucket": "Balanced", "risk_bucket": "Medium", "beta": 1.0}
    df = rows.join(F.broadcast(assets), "symbol", "left")  # a table of literals
    known = F.col("sector").isNotNull()
    return df.select("symbol", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()],
                     *[c for c in rows.columns if c != "symbol"], known.alias("known"))


def select_assets(meta: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose macro_bucket, risk_bucket or asset_class equals a value, ignoring case."""
    return meta.where(F.lower(column) == value.lower())


def metadata_stats(bars: DataFrame, as_of_date: str, benchmark: str = "SPY", silent_days: int = 180) -> DataFrame:
    """Volatility, CAGR, volume, turnover, spread, tracking error and inferred delisting as of a date."""
    bars = bars.where(F.col("ts") <= F.lit(as_of_date).cast("date"))
    bars = index_bars(bars)
    rets = feat.returns(bars).select("symbol", "ts", "close", "ret")
    bench = rets.where(F.col("symbol") == benchmark).select("ts", F.col("ret").alias("_br"))
    te = rets.join(bench, "ts").where(F.col("ret").isNotNull() & F.col("_br").isNotNull()).groupBy("symbol").agg(
        F.when(F.count(F.lit(1)) >= 60, F.stddev_samp(F.col("ret") - F.col("_br")) * feat.ANNUAL).alias("tracking_error"))
    life = rets.groupBy("symbol").agg(
        F.count("close").alias("_n"), (F.stddev_samp("ret") * feat.ANNUAL * 100).alias("_vol"),
        F.min("ts").alias("listing"), F.max("ts").alias("last_ts"),
        F.min_by("close", "ts").alias("_c0"), F.max_by("close", "ts").alias("_c1"))
    years = F.datediff("last_ts", "listing") / 365.25
    cagr = F.when((F.col("_n") > 30) & (years > 0), (F.pow(F.col("_c1") / F.col("_c0"), 1 / years) - 1) * 100)
    recent = liquidity_features(bars)
    tail = recent.groupBy("symbol").agg(F.max_by(F.struct("avg_volume", "turnover", "spread"), "ts").alias("_t"))
    out = life.join(tail, "symbol").join(te, "symbol", "left")
    silent = F.datediff(F.lit(as_of_date).cast("date"), "last_ts") > silent_days
    return out.select("symbol", F.when(F.col("_n") > 30, F.col("_vol")).alias("avg_volatility"), cagr.alias("avg_cagr"), "listing",
                      F.when(silent, F.col("last_ts")).alias("delisting"), F.col("_t.avg_volume").alias("avg_volume"),
                      F.col("_t.turnover").alias("avg_turnover"), F.col("_t.spread").alias("avg_spread"), "tracking_error")


# --------------------------------------------------------------- data quality

def coverage(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """First and last day, bars, expected business days, coverage and missing percent."""
    g = bars.groupBy("symbol").agg(F.min("ts").cast("date").alias("first_day"), F.max("ts").cast("date").alias("last_day"),
                                   F.count(F.lit(1)).alias("total_days"), F.avg("volume").alias("avg_volume"))
    a = F.lit(start).cast("date") if start else F.col("first_day")
    b = F.lit(end).cast("date") if end else F.col("last_day")
    expected = F.size(F.filter(F.sequence(a, b), lambda d: F.weekday(d) < 5))
    cov = F.when(expected > 0, F.col("total_days") / expected * 100).otherwise(0.0)
    return g.select("symbol", "first_day", "last_day", "total_days", expected.cast("bigint").alias("expected_days"),
                    F.round(cov, 2).alias("coverage_pct"), F.round(F.lit(100.0) - cov, 2).alias("missing_pct"), "avg_volume",
                    F.round(F.datediff("last_day", "first_day") / 365.25, 2).alias("history_years"))


def missing_values(df: DataFrame, key: str = "symbol", columns: list[str] | None = None) -> DataFrame:
    """NULL count and percent per (key, column)."""
    columns = columns or [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("total_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = g.unpivot([key, "total_rows"], columns, "column", "missing_count")
    return long.withColumn("missing_pct", F.round(F.col("missing_count") / F.col("total_rows") * 100, 2))


def volume_report(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.avg("volume").alias("avg_daily_volume"), F.max("volume").alias("max_volume"),
                                      F.min("volume").alias("min_volume"))


def diagnostics(bars: DataFrame) -> dict[str, DataFrame]:
    """All reports by name."""
    cov = coverage(bars)
    return {
        "coverage": cov, "missing_values": missing_values(bars),
        "history_length": cov.select("symbol", "first_day", "last_day", "total_days", "history_years"),
        "trading_days": cov.select("symbol", F.col("first_day").alias("first_trading_day"), F.col("last_day").alias("last_trading_day")),
        "volume": volume_report(bars),
    }


def future_bars(bars: DataFrame, now: str, tolerance_days: int = 5) -> DataFrame:
    """Symbols whose newest bar lies more than the tolerance after ``now``."""
    newest = bars.groupBy("symbol").agg(F.max("ts").cast("date").alias("last_day"))
    late = F.datediff("last_day", F.lit(now).cast("date"))
    return newest.where(late > tolerance_days).select("symbol", "last_day", late.alias("days_ahead"), F.lit("future data").alias("issue"))


def execution_delay_issue(spark, delay: int) -> DataFrame:
    """One issue row when signals would be filled on their own bar."""
    return spark.range(1).where(F.lit(delay < 1)).select(F.lit("execution delay below one bar").alias("issue"))
