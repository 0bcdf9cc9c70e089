"""Universe, classification, coverage and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import rounded
from barloom.operators import features as feat, joins, universe as uni
from barloom.plans import dims
from barloom.plans.catalog import query
from barloom.plans.inputs import brand, market
from barloom.plans.sqltext import BY, BRAND, MARKET, r, with_
from barloom.session import cut
from barloom.sources.derived import bars_brand, bars_market, table

# limits scaled to the volume of the test bars
LIMITS = uni.Limits(min_avg_volume=10.0, min_notional=1000.0, min_aum=200000.0, max_spread=0.06, max_turnover=1.5,
                    max_tracking_error=0.25)
START, END = "1995-03-01", "2002-03-01"
_W20 = f"OVER ({BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_B20 = f"OVER ({BY} ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING)"
_LIQ = (f"lr AS (SELECT *, close / lag(close) OVER ({BY}) - 1 AS ret, row_number() OVER ({BY}) AS n FROM bars)",
        f"""liq AS (SELECT symbol, ts, n, CASE WHEN n >= 20 THEN avg(volume) {_W20} END AS av, CASE WHEN n >= 20 THEN avg(volume * close) {_W20} END AS an,
  CASE WHEN n >= 20 THEN avg((high - low) / nullif(close, 0)) {_W20} END AS sp,
  CASE WHEN n >= 40 THEN coalesce(avg(volume) {_W20} / nullif(avg(volume) {_B20}, 0), 0) END AS tu,
  CASE WHEN n >= 60 THEN stddev_samp(ret) OVER ({BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * sqrt(252.0) END AS v60 FROM lr)""",
        "life AS (SELECT symbol, min(ts) AS t0, max(ts) AS t1 FROM bars GROUP BY symbol)")


def _checked(dates: str) -> tuple[str, ...]:
    return (*_LIQ, f"dts AS ({dates})",
            """ask AS (SELECT symbol, as_of FROM life CROSS JOIN dts)""",
            "hit AS (SELECT a.symbol, a.as_of, l.* EXCLUDE (symbol) FROM ask a ASOF LEFT JOIN liq l ON a.symbol = l.symbol AND a.as_of >= l.ts)",
            f"""ck AS (SELECT as_of, h.symbol, coalesce(n, 0) AS history, av AS avg_volume, an AS avg_notional, coalesce(an * 100, 0) AS aum, sp AS spread,
  coalesce(tu, 0) AS turnover, v60 * CASE WHEN h.symbol LIKE '%TQQQ%' THEN 0.5 ELSE 0.3 END AS tracking_error, as_of < t0 AS before_listing,
  t1 + 30 >= as_of AND as_of >= t0 AS ok_d, coalesce(n, 0) >= 252 AS ok_h, coalesce(av >= 10 AND an >= 1000, false) AS ok_v,
  coalesce(an * 100, 0) >= 200000 AS ok_a, coalesce(sp <= 0.06, false) AS ok_s, coalesce(tu <= 1.5, true) AS ok_t,
  h.symbol = 'SPY' OR coalesce(v60 * CASE WHEN h.symbol LIKE '%TQQQ%' THEN 0.5 ELSE 0.3 END <= 0.25, true) AS ok_e
  FROM hit h JOIN life ON life.symbol = h.symbol)""",
            """sn AS (SELECT as_of, symbol, CASE WHEN before_listing THEN 'BeforeIPO' WHEN NOT ok_d THEN 'Delisted' WHEN NOT ok_h THEN 'MinimumHistory'
  WHEN NOT ok_v THEN 'MinimumVolume' WHEN NOT ok_a THEN 'MinimumAUM' WHEN NOT ok_s THEN 'MaximumSpread' WHEN NOT ok_t THEN 'MaximumTurnover'
  WHEN NOT ok_e THEN 'TrackingError' END AS failed FROM ck)""")


_MONTHS = f"SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 MONTH)) AS DATE) AS as_of"


def _monthly(spark, sf_dir):
    return uni.checks(market(spark, sf_dir), uni.monthly_dates(START, END), LIMITS)


def _filter_query(key: str, flag: str, short: str, value: str | None) -> None:
    shown = f", {r(value)}" if value else ""

    @query(key, with_(MARKET, *_checked(_MONTHS)) + f"SELECT as_of, symbol, {short} AS passed{shown} FROM ck")
    def run(spark, sf_dir):
        df = _monthly(spark, sf_dir)
        return rounded(df.select("as_of", "symbol", F.col(f"ok_{flag}").alias("passed"), *([F.col(value).cast("double").alias(value)] if value else [])))


for _args in (("b7_minimum_history", "MinimumHistory", "ok_h", None), ("b8_delisted", "Delisted", "ok_d", None),
              ("b9_minimum_volume", "MinimumVolume", "ok_v", "avg_volume"), ("b10_minimum_aum", "MinimumAUM", "ok_a", "aum"),
              ("b11_maximum_spread", "MaximumSpread", "ok_s", "spread"), ("b12_maximum_turnover", "MaximumTurnover", "ok_t", "turnover"),
              ("b13_tracking_error", "TrackingError", "ok_e", "tracking_error")):
    _filter_query(*_args)


@query("b14_filter_chain", with_(MARKET, *_checked(_MONTHS)) + "SELECT as_of, symbol, failed IS NULL AS included, failed AS failed_filter FROM sn")
def b14(spark, sf_dir):
    return uni.snapshots(_monthly(spark, sf_dir))


# metadata of some symbols, derived from their bars: late listing, delisting, assets and tracking error given
_META = """meta AS (SELECT symbol, CASE WHEN length(symbol) = 4 THEN min(ts) + 120 END AS listing, CASE WHEN symbol LIKE 'X%' THEN min(ts) + 1900 END AS delisting,
  CASE WHEN symbol LIKE '%L%' THEN sum(volume) * 10 END AS given_aum, CASE WHEN symbol LIKE '%Y%' THEN count(*) / 5000.0::DOUBLE END AS given_te FROM bars GROUP BY symbol)"""


def _meta(bars):
    g = bars.groupBy("symbol").agg(F.min("ts").alias("_t"), F.sum("volume").alias("_v"), F.count(F.lit(1)).alias("_n"))
    c = F.col("symbol")
    return g.select("symbol", F.when(F.length("symbol") == 4, F.date_add("_t", 120)).alias("listing"), F.when(c.startswith("X"), F.date_add("_t", 1900)).alias("delisting"),
                    F.when(c.contains("L"), F.col("_v") * 10).alias("aum"), F.when(c.contains("Y"), F.col("_n") / 5000).alias("tracking_error"))


def _checked_with_metadata(dates: str) -> tuple[str, ...]:
    """The filters with listing, delisting, assets and tracking error from metadata where given."""
    out = []
    for cte in _checked(dates):
        cte = cte.replace("coalesce(an * 100, 0)", "coalesce(given_aum, an * 100, 0)")
        cte = cte.replace("v60 * CASE WHEN h.symbol LIKE '%TQQQ%' THEN 0.5 ELSE 0.3 END", "coalesce(given_te, v60 * CASE WHEN h.symbol LIKE '%TQQQ%' THEN 0.5 ELSE 0.3 END)")
        cte = cte.replace("as_of < t0 AS before_listing", "as_of < coalesce(listing, t0) AS before_listing, coalesce(as_of > delisting, false) AS after_delisting")
        cte = cte.replace("t1 + 30 >= as_of AND as_of >= t0 AS ok_d", "coalesce(delisting > as_of, true) AND t1 + 30 >= as_of AND as_of >= t0 AS ok_d")
        cte = cte.replace("FROM hit h JOIN life ON life.symbol = h.symbol", "FROM hit h JOIN life ON life.symbol = h.symbol JOIN meta ON meta.symbol = h.symbol")
        out.append(cte.replace("WHEN NOT ok_d THEN 'Delisted'", "WHEN after_delisting THEN 'Delisted' WHEN NOT ok_d THEN 'Delisted'"))
    return (_META, *out)


def _monthly_with_metadata(spark, sf_dir):
    bars = market(spark, sf_dir)
    return uni.checks(bars, uni.monthly_dates(START, END), LIMITS, _meta(bars))


@query("b14_filter_chain_with_metadata", with_(MARKET, *_checked_with_metadata(_MONTHS)) + f"""SELECT sn.as_of, sn.symbol, failed IS NULL AS included, failed AS failed_filter,
  ok_d AS listed, ok_a AS enough_aum, {r('aum')}, ok_e AS tracks, {r('tracking_error')} FROM sn JOIN ck ON ck.as_of = sn.as_of AND ck.symbol = sn.symbol""")
def b14_metadata(spark, sf_dir):
    """Delisting, given assets and given tracking error, each with its verdict."""
    df = cut(_monthly_with_metadata(spark, sf_dir))
    own = df.select("as_of", "symbol", F.col("ok_Delisted").alias("listed"), F.col("ok_MinimumAUM").alias("enough_aum"), F.round("aum", 6).alias("aum"),
                    F.col("ok_TrackingError").alias("tracks"), F.round("tracking_error", 6).alias("tracking_error"))
    return uni.snapshots(df).join(own, ["as_of", "symbol"])


@query("c5_point_in_time", with_(MARKET, _META, f"dts AS ({_MONTHS})", "lf AS (SELECT symbol, coalesce(listing, min(ts)) AS since, delisting FROM bars JOIN meta USING (symbol) GROUP BY symbol, listing, delisting)") +
       "SELECT as_of, symbol FROM dts JOIN lf ON since <= as_of AND (delisting IS NULL OR as_of <= delisting)")
def c5(spark, sf_dir):
    bars = cut(bars_market(spark, sf_dir))
    dates = spark.range(1).select(F.explode(uni.monthly_dates(START, END)).alias("as_of"))
    return uni.members_at(uni.listed_spans(bars, _meta(bars)), dates)


@query("c5_inclusion_spans", with_(MARKET, *_checked_with_metadata(f"SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS as_of"),
       "fl AS (SELECT symbol, as_of, as_of - CAST(row_number() OVER (PARTITION BY symbol ORDER BY as_of) AS INT) AS island FROM sn WHERE failed IS NULL)") +
       "SELECT symbol, min(as_of) AS since, max(as_of) AS until FROM fl GROUP BY symbol, island")
def c5_spans(spark, sf_dir):
    bars = market(spark, sf_dir)
    return uni.inclusion_spans(bars, LIMITS, _meta(bars))


@query("d30_universe_size", with_(MARKET, *_checked(_MONTHS)) + "SELECT as_of, count(*) FILTER (failed IS NULL) AS size FROM sn GROUP BY as_of")
def d30(spark, sf_dir):
    dates = spark.range(1).select(F.explode(uni.monthly_dates(START, END)).alias("as_of"))
    return uni.size_over_time(uni.inclusion_spans(market(spark, sf_dir), LIMITS), dates)


_DAYS = "SELECT DISTINCT ts AS as_of FROM bars"


@query("d31_survivorship_bias", with_(MARKET, *_checked(_DAYS),
       "rr AS (SELECT symbol, ts, ret FROM lr WHERE ret IS NOT NULL)",
       """dy AS (SELECT rr.ts, sum(ret) / (SELECT count(DISTINCT symbol) FROM rr) AS st, coalesce(avg(ret) FILTER (failed IS NULL), 0) AS dn
  FROM rr JOIN sn ON sn.symbol = rr.symbol AND sn.as_of = rr.ts GROUP BY rr.ts)""",
       """cg AS (SELECT pow(product(1 + st) / (1 + min_by(st, ts)), 365.25 / (max(ts) - min(ts))) - 1 AS a,
  pow(product(1 + dn) / (1 + min_by(dn, ts)), 365.25 / (max(ts) - min(ts))) - 1 AS b FROM dy)""",
       "sz AS (SELECT avg(c) AS m FROM (SELECT count(*) FILTER (failed IS NULL) AS c FROM sn GROUP BY as_of))",
       "ct AS (SELECT count(DISTINCT symbol) AS n FROM rr)",
       "fx AS (SELECT n, m, (n - m) / n * 100 AS diff, a, b, coalesce((a - b) / nullif(abs(b), 0), 0) * 100 AS score FROM ct, sz, cg)") +
       f"""SELECT n AS static_size, {r('m', 'dynamic_avg_size', 4)}, {r('diff', 'size_diff_pct', 4)}, {r('a * 100', 'static_cagr', 4)}, {r('b * 100', 'dynamic_cagr', 4)},
  {r('score', 'bias_score_pct', 3)}, CASE WHEN abs(score) > 20 THEN 'very high' WHEN abs(score) > 10 THEN 'high' WHEN abs(score) > 5 THEN 'moderate'
  WHEN abs(diff) > 10 THEN 'high size bias' ELSE 'low' END AS interpretation FROM fx""")
def d31(spark, sf_dir):
    bars = market(spark, sf_dir)
    rets = feat.returns(bars).select("symbol", "ts", "ret")
    df = uni.survivorship_bias(rets, uni.inclusion_spans(bars, LIMITS))
    digits = {"bias_score_pct": 3}
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits.get(c, 4)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


@query("d1_coverage", with_(BRAND) + f"""SELECT symbol, min(ts) AS first_day, max(ts) AS last_day, count(*) AS total_days,
  len(list_filter(generate_series(min(ts), max(ts), INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS expected_days,
  {r("count(*) * 100.0::DOUBLE / len(list_filter(generate_series(min(ts), max(ts), INTERVAL 1 DAY), lambda x: isodow(x) < 6))", 'coverage_pct', 2)},
  {r("100 - count(*) * 100.0::DOUBLE / len(list_filter(generate_series(min(ts), max(ts), INTERVAL 1 DAY), lambda x: isodow(x) < 6))", 'missing_pct', 2)},
  {r('avg(volume)', 'avg_volume', 7)}, {r('(max(ts) - min(ts)) / 365.25', 'history_years', 2)} FROM bars GROUP BY symbol""")
def d1(spark, sf_dir):
    return rounded(uni.coverage(bars_brand(spark, sf_dir)), 7)


_GAPPY = """gp AS (SELECT c.c_nationkey AS symbol, o_totalprice AS price, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey END AS key
  FROM customer c LEFT JOIN orders ON o_custkey = c_custkey)"""


@query("d2_missing_values", with_(_GAPPY) + f"""SELECT symbol, "column", missing_count, {r('missing_count * 100.0 / total_rows', 'missing_pct', 2)}, total_rows FROM (
  SELECT symbol, 'price' AS "column", count(*) - count(price) AS missing_count, count(*) AS total_rows FROM gp GROUP BY symbol
  UNION ALL SELECT symbol, 'key', count(*) - count(key), count(*) FROM gp GROUP BY symbol)""")
def d2(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("key"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("symbol"))
    df = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("symbol", "price", "key")
    return uni.missing_values(df)


@query("d3_history_length", with_(BRAND) + f"""SELECT symbol, min(ts) AS first_day, max(ts) AS last_day, count(*) AS total_days,
  {r('(max(ts) - min(ts)) / 365.25', 'history_years', 2)} FROM bars GROUP BY symbol""")
def d3(spark, sf_dir):
    return uni.diagnostics(bars_brand(spark, sf_dir))["history_length"]


@query("d3_trading_days", with_(BRAND) + "SELECT symbol, min(ts) AS first_trading_day, max(ts) AS last_trading_day FROM bars GROUP BY symbol")
def d3b(spark, sf_dir):
    return uni.diagnostics(bars_brand(spark, sf_dir))["trading_days"]


@query("d4_volume_report", with_(BRAND) + f"""SELECT symbol, {r('avg(volume)', 'avg_daily_volume', 7)}, {r('max(volume)', 'max_volume', 7)},
  {r('min(volume)', 'min_volume', 7)} FROM bars GROUP BY symbol""")
def d4(spark, sf_dir):
    return rounded(uni.diagnostics(bars_brand(spark, sf_dir))["volume"], 7)


@query("d5_metadata_stats", with_(MARKET.replace("FROM named)", "FROM named WHERE ts <= DATE '2001-06-30')"), *_LIQ,
       """te AS (SELECT a.symbol, CASE WHEN count(*) >= 60 THEN stddev_samp(a.ret - b.ret) * sqrt(252.0) END AS te FROM lr a JOIN lr b ON a.ts = b.ts AND b.symbol = 'SPY'
  WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.symbol)""",
       """st AS (SELECT symbol, count(*) AS n, stddev_samp(ret) * sqrt(252.0) * 100 AS vol, min(ts) AS listing, max(ts) AS t1, min_by(close, ts) AS c0, max_by(close, ts) AS c1
  FROM lr GROUP BY symbol)""",
       "ta AS (SELECT symbol, max_by(av, ts) AS av, max_by(tu, ts) AS tu, max_by(sp, ts) AS sp FROM liq GROUP BY symbol)") +
       f"""SELECT symbol, {r('CASE WHEN n > 30 THEN vol END', 'avg_volatility', 4)}, {r('CASE WHEN n > 30 THEN (pow(c1 / c0, 365.25 / (t1 - listing)) - 1) * 100 END', 'avg_cagr', 4)},
  listing, CASE WHEN DATE '2001-06-30' - t1 > 180 THEN t1 END AS delisting, {r('av', 'avg_volume', 4)}, {r('tu', 'avg_turnover', 4)}, {r('sp', 'avg_spread', 4)},
  {r('te', 'tracking_error', 4)} FROM st JOIN ta USING (symbol) LEFT JOIN te USING (symbol)""")
def d5(spark, sf_dir):
    return rounded(uni.metadata_stats(bars_market(spark, sf_dir), "2001-06-30"), 4)


@query("b16_future_bars", with_(BRAND) + """SELECT symbol, max(ts) AS last_day, CAST(max(ts) - DATE '2001-10-25' AS INT) AS days_ahead, 'future data' AS issue
  FROM bars GROUP BY symbol HAVING max(ts) - DATE '2001-10-25' > 5""")
def b16(spark, sf_dir):
    return uni.future_bars(bars_brand(spark, sf_dir), "2001-10-25")


_ASSET = "ast(symbol, asset_class, sector, macro_bucket, risk_bucket, beta) AS (" + dims.values(dims.ASSETS) + ")"


@query("b5_classification", with_(MARKET, _ASSET, f"rr AS (SELECT symbol, close / lag(close) OVER ({BY}) - 1 AS ret FROM bars)",
       "vv AS (SELECT symbol, stddev_samp(ret) * sqrt(252.0) * 100 AS vol FROM rr GROUP BY symbol)") + """SELECT symbol, coalesce(asset_class, 'Equity') AS asset_class,
  CASE WHEN symbol IN ('XLU','XLP','XLV','BIL','IEF') OR lower(coalesce(sector, '')) LIKE '%utilities%' OR lower(coalesce(sector, '')) LIKE '%staples%' OR lower(coalesce(sector, '')) LIKE '%health%' THEN 'Defensive'
    WHEN symbol IN ('XLE','XLB','USO') OR lower(coalesce(sector, '')) LIKE '%energy%' OR lower(coalesce(sector, '')) LIKE '%materials%' THEN 'Inflation'
    WHEN symbol IN ('GLD','SLV','TLT') OR lower(coalesce(sector, '')) LIKE '%gold%' THEN 'Safe Haven' WHEN symbol = 'UUP' THEN 'Dollar' WHEN symbol = 'VIXY' THEN 'Fear'
    WHEN symbol IN ('SVXY','QQQ','TQQQ','XLK','XLY','BTC-USD','MES=F','SPY','IWM') THEN 'Risk On' WHEN symbol IN ('HYG','LQD') THEN 'Credit' ELSE 'Balanced' END AS macro_bucket,
  CASE WHEN abs(coalesce(beta, 1)) >= 3 OR vol >= 50 THEN 'Very High' WHEN abs(coalesce(beta, 1)) >= 1.3 OR vol >= 28 THEN 'High'
    WHEN abs(coalesce(beta, 1)) >= 0.8 OR vol >= 16 THEN 'Medium' ELSE 'Low' END AS risk_bucket FROM vv LEFT JOIN ast USING (symbol)""")
def b5(spark, sf_dir):
    rets = feat.returns(cut(bars_market(spark, sf_dir)))
    vol = rets.groupBy("symbol").agg((F.stddev_samp("ret") * feat.ANNUAL * 100).alias("vol"))
    known = uni.known_assets(spark).select("symbol", F.col("asset_class").alias("_cls"), "sector", "beta")
    df = vol.join(F.broadcast(known), "symbol", "left")
    cls = uni.asset_class(F.col("symbol"), F.col("_cls"))
    return df.select("symbol", cls.alias("asset_class"), uni.macro_bucket(F.col("symbol"), F.col("sector"), cls).alias("macro_bucket"),
                     uni.risk_bucket(F.coalesce(F.col("beta"), F.lit(1.0)), F.col("vol"), cls).alias("risk_bucket"))


@query("b6_select_by_bucket", with_(MARKET, _ASSET) + """SELECT symbol, macro_bucket, count(*) AS bars FROM bars JOIN ast USING (symbol)
  WHERE lower(macro_bucket) = 'risk on' GROUP BY symbol, macro_bucket""")
def b6(spark, sf_dir):
    chosen = uni.select_assets(uni.known_assets(spark), "macro_bucket", "RISK ON").select("symbol", "macro_bucket")
    return bars_market(spark, sf_dir).join(F.broadcast(chosen), "symbol").groupBy("symbol", "macro_bucket").agg(F.count(F.lit(1)).alias("bars"))


@query("c4_metadata_lookup", with_(MARKET, _ASSET, f"rr AS (SELECT symbol, close / lag(close) OVER ({BY}) - 1 AS ret, volume FROM bars)",
       "vv AS (SELECT symbol, stddev_samp(ret) * sqrt(252.0) * 100 AS vol, avg(volume) AS avg_volume, count(*) AS bars FROM rr GROUP BY symbol)") +
       f"""SELECT symbol, coalesce(asset_class, 'Equity') AS asset_class, coalesce(sector, 'Unknown') AS sector, coalesce(macro_bucket, 'Balanced') AS macro_bucket,
  coalesce(risk_bucket, 'Medium') AS risk_bucket, coalesce(beta, 1.0)::DOUBLE AS beta, {r('vol', 'volatility_pct', 4)}, {r('avg_volume', digits=4)}, bars, sector IS NOT NULL AS known
  FROM vv LEFT JOIN ast USING (symbol)""")
def c4(spark, sf_dir):
    """The whole asset frame: what the table knows, defaults for the rest, and the measured columns."""
    rets = feat.returns(cut(bars_market(spark, sf_dir)))
    n = rets.groupBy("symbol").agg((F.stddev_samp("ret") * feat.ANNUAL * 100).alias("volatility_pct"), F.avg("volume").alias("avg_volume"), F.count(F.lit(1)).alias("bars"))
    df = uni.with_assets(n, uni.known_assets(spark))
    return rounded(df, 4)


@query("c6_execution_price", with_(BRAND, "nb AS (SELECT *, row_number() OVER (" + BY + ") AS i FROM bars)",
       """od AS (SELECT o_orderkey AS order_id, 'Brand#' || (o_custkey % 25 + 1) AS symbol, CAST(o_orderdate AS DATE) AS ts,
  CASE WHEN o_orderstatus = 'F' THEN 'SELL' ELSE 'BUY' END AS side, round(o_totalprice / 1000) AS quantity FROM orders)""",
       "ft AS (SELECT od.*, b.i FROM od ASOF JOIN nb b ON od.symbol = b.symbol AND od.ts <= b.ts)") + f"""SELECT order_id, ft.symbol, ft.ts, b.ts AS fill_ts,
  {r("b.open * (1 + CASE side WHEN 'BUY' THEN 1 ELSE -1 END * 2.0 / 10000)", 'exec_price', 3)},
  {r("abs(quantity * b.open * (1 + CASE side WHEN 'BUY' THEN 1 ELSE -1 END * 2.0 / 10000)) * 0.0005", 'commission', 4)} FROM ft JOIN nb b ON b.symbol = ft.symbol AND b.i = ft.i + 1""")
def c6(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    orders = o.select(F.col("o_orderkey").alias("order_id"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("symbol"),
                      F.col("o_orderdate").cast("date").alias("ts"), F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY").alias("side"),
                      F.round(F.col("o_totalprice") / 1000).alias("quantity"))
    df = joins.execution_prices(orders, brand(spark, sf_dir))
    return df.select("order_id", "symbol", "ts", "fill_ts", F.round("exec_price", 3).alias("exec_price"), F.round("commission", 4).alias("commission"))


@query("c7_asof_last_close", with_(BRAND, """od AS (SELECT o_orderkey AS order_id, 'Brand#' || (o_custkey % 25 + 1) AS symbol, CAST(o_orderdate AS DATE) AS ts FROM orders)""") +
       f"SELECT order_id, od.symbol, od.ts, b.ts AS matched_ts, {r('b.close', 'close')} FROM od ASOF LEFT JOIN bars b ON od.symbol = b.symbol AND od.ts >= b.ts")
def c7(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    orders = o.select(F.col("o_orderkey").alias("order_id"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("symbol"),
                      F.col("o_orderdate").cast("date").alias("ts"))
    return rounded(joins.asof_backward(orders, bars_brand(spark, sf_dir).select("symbol", "ts", "close")))


@query("c11_benchmark_alignment", with_(MARKET, f"eq AS (SELECT ts, close FROM bars WHERE symbol = 'QQQ')") +
       f"SELECT e.ts, {r('e.close', 'equity')}, {r('b.close', 'benchmark')} FROM eq e ASOF LEFT JOIN (SELECT * FROM bars WHERE symbol = 'SPY') b ON e.ts >= b.ts")
def c11(spark, sf_dir):
    bars = cut(bars_market(spark, sf_dir))
    left = bars.where(F.col("symbol") == "QQQ").select(F.lit(1).alias("g"), "ts", F.col("close").alias("equity"))
    right = bars.where(F.col("symbol") == "SPY").select(F.lit(1).alias("g"), "ts", F.col("close").alias("benchmark"))
    return rounded(joins.asof_backward(left, right, ("g",)).select("ts", "equity", "benchmark"))


@query("c1_benchmark_join", with_(MARKET) + f"""SELECT a.symbol, a.ts, {r('a.close', 'close')}, {r('b.close', 'bench_close')} FROM bars a JOIN bars b ON a.ts = b.ts AND b.symbol = 'SPY'""")
def c1(spark, sf_dir):
    return rounded(feat.join_benchmark(bars_market(spark, sf_dir).select("symbol", "ts", "close"), "SPY", {"close": "bench_close"}))


@query("c2_long_short_return", with_(MARKET, f"rr AS (SELECT symbol, ts, close / lag(close) OVER ({BY}) - 1 AS ret FROM bars)") +
       f"SELECT a.ts, {r('a.ret - b.ret', 'ret')} FROM rr a JOIN rr b ON a.ts = b.ts WHERE a.symbol = 'HYG' AND b.symbol = 'IEF'")
def c2(spark, sf_dir):
    rets = cut(feat.returns(cut(bars_market(spark, sf_dir).where(F.col("symbol").isin("HYG", "IEF")))))
    a = rets.where(F.col("symbol") == "HYG").select("ts", F.col("ret").alias("_a"))
    b = rets.where(F.col("symbol") == "IEF").select("ts", F.col("ret").alias("_b"))
    return rounded(a.join(b, "ts").select("ts", (F.col("_a") - F.col("_b")).alias("ret")))
