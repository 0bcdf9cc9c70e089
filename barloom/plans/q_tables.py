"""Sources, sinks, ledgers, set operations, text records and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions.scalars import rounded
from barloom.operators import features as feat, portfolio as pf, regimes as reg, rotation as rot, signals as sig, text as tx
from barloom.operators.panel import panel
from barloom.plans import dims
from barloom.plans.catalog import query
from barloom.plans.inputs import brand, flag, market
from barloom.plans.q_portfolio import CASH, HIGH, LOW, _constrain
from barloom.plans.q_regimes import BASE, _ALL, _MACRO, _META, _SIX, _VOTE, _wide
from barloom.plans.q_rotation import ENSEMBLE, _ENS, recursive
from barloom.plans.q_signals import SCREEN, TREND, TRIG, temacd_sql
from barloom.plans.sqltext import BRAND, BY, FLAG, HOUR, MARKET, PANEL, ema, r, with_
from barloom.session import cut, work_folder
from barloom.sources import bars as store, ledger, sinks, tickers
from barloom.sources.derived import bars_brand, bars_flag, bars_market, table
from barloom.streaming import bars as stream


def _place(spark) -> str:
    return f"{work_folder(spark)}/{uuid.uuid4().hex}"


@query("a1_scan_slice", with_(BRAND) + f"SELECT symbol, ts, {r('close')}, volume FROM bars WHERE ts BETWEEN DATE '1997-03-01' AND DATE '1998-02-15'")
def a1(spark, sf_dir):
    path = _place(spark)
    store.write_bars(bars_brand(spark, sf_dir), path)
    return rounded(store.scan_bars(spark, path, "1997-03-01", "1998-02-15").select("symbol", "ts", "close", "volume"))


@query("a2_normalise", """SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS ts,
  max_by(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close,
  max_by(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS volume FROM lineitem GROUP BY l_returnflag, CAST(l_shipdate AS DATE)""")
def a2(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("ts"), F.col("l_extendedprice").alias("close"),
                    F.col("l_quantity").alias("volume"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("_seq"))
    return store.normalise(raw)


_MERGE = "st AS (SELECT symbol, ts, close FROM bars WHERE ts < DATE '1999-01-01'), fr AS (SELECT symbol, ts, close + 1 AS close FROM bars WHERE ts >= DATE '1998-06-01')"


@query("a3_merge_fresh", with_(BRAND, _MERGE) + f"""SELECT symbol, ts, {r('close')} FROM fr UNION ALL SELECT symbol, ts, {r('close')} FROM st WHERE (symbol, ts) NOT IN (SELECT (symbol, ts) FROM fr)""")
def a3(spark, sf_dir):
    path = _place(spark)
    bars = cut(bars_brand(spark, sf_dir))
    store.write_bars(bars.where(F.col("ts") < F.lit("1999-01-01").cast("date")), path)
    fresh = bars.where(F.col("ts") >= F.lit("1998-06-01").cast("date")).withColumn("close", F.col("close") + 1)
    store.update_store(spark, path, fresh)
    return rounded(store.scan_bars(spark, path).select("symbol", "ts", "close"))


_WORDS = "(SELECT p_brand AS w FROM part UNION ALL SELECT '  ' || c_mktsegment || ' ' FROM customer UNION ALL SELECT c_name FROM customer UNION ALL SELECT event_type FROM events UNION ALL SELECT p_name FROM part UNION ALL SELECT url FROM pages)"
_VALID = "length(t) <= 20 AND regexp_full_match(t, '[A-Z0-9.\\-^/=]+')"


@query("a4_clean_tickers", f"SELECT DISTINCT t AS symbol FROM (SELECT upper(trim(w)) AS t FROM {_WORDS}) WHERE {_VALID}")
def a4(spark, sf_dir):
    p, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    words = p.select(F.col("p_brand").alias("w")).union(c.select(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))).union(
        c.select("c_name")).union(table(spark, sf_dir, "events").select("event_type")).union(p.select("p_name")).union(table(spark, sf_dir, "pages").select("url"))
    return tickers.clean_tickers(words, "w")


@query("a5_ticker_file", f"""SELECT DISTINCT t AS symbol FROM (SELECT upper(trim(unnest(regexp_split_to_array(l, '[,\\s]+')))) AS t
  FROM (SELECT trim(p_name || ',' || p_brand || ' ' || p_type) AS l FROM part UNION ALL SELECT trim(url) FROM pages) WHERE NOT starts_with(l, '#') AND l <> '') WHERE {_VALID}""")
def a5(spark, sf_dir):
    path = _place(spark)
    lines = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(","), "p_brand", F.lit(" "), "p_type").alias("value"))
    lines = lines.union(table(spark, sf_dir, "part").select(F.concat(F.lit("# "), "p_name"))).union(table(spark, sf_dir, "pages").select("url"))
    lines.write.text(path)
    return tickers.read_tickers(spark, path)


@query("a6_screener_csv", with_(BRAND, *SCREEN, recursive=True) + "SELECT symbol, signal, trend, " + ", ".join(
    f"printf('%.{d}f', {c}) AS {c}" for c, d in (("close", 2), ("chg_pct", 2), ("delta", 4), ("ema1", 2), ("ema2", 2), ("ema3", 2))) +
    ", array_to_string(triggers, '; ') AS triggers, strftime(date, '%Y-%m-%d') AS date FROM screen")
def a6(spark, sf_dir):
    path = _place(spark)
    sinks.write_screener(sig.screener(brand(spark, sf_dir)), path)
    return spark.read.csv(path, header=True)


@query("a7_equity_csv", with_(FLAG, f"rr AS (SELECT symbol, ts, close / lag(close) OVER ({BY}) - 1 AS ret FROM bars)",
       f"eq AS (SELECT symbol, ts, ret, 100000 * product(1 + coalesce(ret, 0)) OVER ({BY}) AS equity, CAST(date_trunc('month', ts) AS DATE) AS period FROM rr)",
       "mo AS (SELECT symbol, period, product(1 + coalesce(ret, 0)) - 1 AS m FROM eq GROUP BY symbol, period)") +
       f"SELECT symbol, ts, {r('equity', digits=4)}, {r('ret', digits=7)}, {r('m', 'month_ret')} FROM eq JOIN mo USING (symbol, period)")
def a7(spark, sf_dir):
    """Both files as they were written: every equity row with the return of its month."""
    from barloom.operators.backtest import equity_curve
    path = _place(spark)
    curve = cut(equity_curve(feat.returns(flag(spark, sf_dir)), ("symbol",), capital=100000.0))
    sinks.write_equity(curve, path, ("symbol",))
    equity = spark.read.schema("symbol string, ts date, equity double, ret double").csv(f"{path}/equity", header=True)
    monthly = spark.read.schema("symbol string, period date, month_ret double").csv(f"{path}/monthly", header=True)
    both = equity.withColumn("period", F.trunc("ts", "month")).join(monthly, ["symbol", "period"])
    return both.select("symbol", "ts", F.round("equity", 4).alias("equity"), F.round("ret", 7).alias("ret"), F.round("month_ret", 6).alias("month_ret"))


@query("a8_daily_manifest", with_(*BASE, _MACRO, _SIX, *SCREEN, "rg(regime_id, regime, eq, hedge, cash, engine) AS (" + dims.values(dims.REGIMES) + ")",
       "al(regime_id, symbol) AS (" + dims.values(dims.REGIME_ALLOWED) + ")", "cur AS (SELECT regime_id FROM six WHERE ts = (SELECT max(ts) FROM six))",
       """kp AS (SELECT symbol FROM screen, cur WHERE signal = 'LONG ENTRY' AND regime_id NOT IN (5, 6) AND (regime_id NOT IN (2, 4)
  OR EXISTS (SELECT 1 FROM al WHERE al.regime_id = cur.regime_id AND al.symbol = screen.symbol)))""", recursive=True) +
       """SELECT cur.regime_id, regime, eq, hedge, cash, (SELECT count(*) FROM screen WHERE signal = 'LONG ENTRY') AS raw_longs, (SELECT count(*) FROM screen WHERE signal = 'SHORT/EXIT') AS raw_shorts,
  coalesce((SELECT string_agg(symbol, ',' ORDER BY symbol) FROM kp), '') AS filtered_longs, coalesce((SELECT string_agg(symbol, ',' ORDER BY symbol) FROM screen WHERE signal = 'SHORT/EXIT'), '') AS shorts
  FROM cur JOIN rg USING (regime_id)""")
def a8(spark, sf_dir):
    bars = market(spark, sf_dir)
    screen = cut(sig.screener(bars))
    now = cut(reg.classify(reg.macro(reg.inputs(bars))).agg(F.max_by("regime_id", "ts").alias("regime_id")))
    regime = reg.with_allocation(now).drop("engine")
    one = now.withColumn("ts", F.lit(0))
    longs = reg.regime_filter(screen.where(F.col("signal") == "LONG ENTRY").select("symbol", F.lit(0).alias("ts")), one)
    path = _place(spark)
    sinks.manifest(screen, longs.select("symbol"), regime).write.json(path)
    back = spark.read.schema("regime_id int, regime string, eq int, hedge int, cash int, raw_longs long, raw_shorts long, filtered_longs array<string>, shorts array<string>").json(path)
    return back.withColumns({"filtered_longs": F.array_join("filtered_longs", ","), "shorts": F.array_join("shorts", ",")})


_HASH = """pr AS (SELECT o_orderpriority AS p, c_mktsegment AS symbol, min_by(o_totalprice, o_orderkey) AS a, max_by(o_totalprice, o_orderkey) AS b, count(*) AS n
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
tx AS (SELECT p, left(sha256(symbol), 2) AS g, symbol || ':' || printf('%.6f', a) || ':' || printf('%.6f', b) || ':' || n AS t FROM pr),
dg AS (SELECT p, g || sha256(string_agg(t, '|' ORDER BY t)) AS d FROM tx GROUP BY p, g),
hs AS (SELECT p, left(sha256(string_agg(d, '|' ORDER BY d)), 16) AS data_hash FROM dg GROUP BY p)"""


def _priced(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("ts"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"))


@query("h11_data_hash", with_(_HASH) + "SELECT p, data_hash FROM hs")
def h11(spark, sf_dir):
    return ledger.data_hash(_priced(spark, sf_dir), ("p",))


def _records(spark, sf_dir):
    h = ledger.data_hash(_priced(spark, sf_dir), ("p",))
    config = F.to_json(F.struct(F.col("p").alias("universe")))
    return h.select(ledger.experiment_id(config, F.col("data_hash"), F.lit("{}"), F.lit("ema_cross")).alias("experiment_id"), F.col("p").alias("universe"), "data_hash",
                    F.lit("1995-01-01 to 1998-12-31").alias("train_period"), F.lit("1999-01-01 to 2001-12-31").alias("test_period"),
                    F.lit("trend persists through slow capital").alias("hypothesis"))


_EXPERIMENT = """ex AS (SELECT left(sha256('{"universe":"' || p || '"}' || data_hash || '{}' || 'ema_cross'), 12) AS experiment_id, p AS universe, data_hash FROM hs)"""


@query("a9_experiment_registry", with_(_HASH, _EXPERIMENT) + """SELECT experiment_id, universe, data_hash, row_number() OVER (ORDER BY universe, experiment_id) AS place,
  '1995-01-01 to 1998-12-31' AS train_period, '1999-01-01 to 2001-12-31' AS test_period, 'trend persists through slow capital' AS hypothesis FROM ex""")
def a9(spark, sf_dir):
    """The registry's list, read back from its export."""
    path = _place(spark)
    rec = cut(_records(spark, sf_dir))
    ledger.register(rec, path)
    ledger.register(rec, path)  # a second registration adds nothing
    listed = ledger.list_records(spark, path, "universe")
    ledger.export_records(listed, f"{path}-list")
    back = spark.read.schema(listed.schema).json(f"{path}-list")
    return back.select("experiment_id", "universe", "data_hash", "place", "train_period", "test_period", "hypothesis")


@query("a9_export_record", with_(_HASH, _EXPERIMENT) + "SELECT experiment_id, universe, data_hash FROM ex WHERE universe = (SELECT min(universe) FROM ex)")
def a9_export(spark, sf_dir):
    path = _place(spark)
    rec = cut(_records(spark, sf_dir))
    ledger.register(rec, path)
    ledger.export_record(spark, path, rec.agg(F.min_by("experiment_id", "universe")).first()[0], f"{path}-one")
    return spark.read.schema(rec.schema).json(f"{path}-one").select("experiment_id", "universe", "data_hash")


@query("b17_period_guard", """SELECT o_orderkey AS experiment_id, CASE WHEN CAST(o_orderdate AS DATE) + 30 >= DATE '1998-01-01' THEN 'train overlaps test' ELSE 'hypothesis too short' END AS issue
  FROM orders WHERE CAST(o_orderdate AS DATE) + 30 >= DATE '1998-01-01' OR length(trim(o_orderpriority)) < 8""")
def b17(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    rec = o.select(F.col("o_orderkey").alias("experiment_id"),
                   F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" to "), F.date_format(F.date_add(day, 30), "yyyy-MM-dd")).alias("train_period"),
                   F.lit("1998-01-01 to 1999-01-01").alias("test_period"), F.col("o_orderpriority").alias("hypothesis"))
    return ledger.period_issues(rec, 8).select("experiment_id", "issue")


@query("a10_decision_log", with_(*BASE, _ALL, _VOTE, *_META, "vw AS (SELECT ts, symbol, sqrt(volume) / sum(sqrt(volume)) OVER (PARTITION BY ts) AS raw FROM bars)", _constrain("raw", "vw"), "cw AS (SELECT ts, count(*) FILTER (signal = 'RiskOn') AS a, count(*) FILTER (signal = 'RiskOff') AS b, list(name || ' ' || signal ORDER BY name) AS l FROM cn GROUP BY ts)",
       recursive=True) + """SELECT vt.ts, vt.regime AS final_regime, a AS risk_on_votes, b AS risk_off_votes, (SELECT string_agg(layer || '=' || regime, ';' ORDER BY layer) FROM ly WHERE ly.ts = vt.ts) AS layers,
  array_to_string(l, ';') AS canaries, (SELECT count(DISTINCT symbol) FROM bars WHERE bars.ts = vt.ts) AS held,
  (SELECT string_agg(symbol || '=' || printf('%.7f', round(weight, 7)), ';' ORDER BY symbol) FROM w WHERE w.ts = vt.ts) AS weights,
  printf('On %s: regime %s, confidence %.4f. Votes %d on, %d off. Canaries: %s.', strftime(vt.ts, '%Y-%m-%d'), vt.regime, round(vt.confidence, 9), a, b, array_to_string(l[1:4], '; ')) AS human_readable FROM vt JOIN cw USING (ts)""")
def a10(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    cn = cut(reg.canaries(wide))
    vote = reg.vote(cn).withColumn("confidence", F.round("confidence", 9))
    bars = cut(bars_market(spark, sf_dir).select("ts", "symbol", F.sqrt("volume").alias("_v")))
    w = bars.join(bars.groupBy("ts").agg(F.sum("_v").alias("_t")), "ts").select("ts", "symbol", (F.col("_v") / F.col("_t")).alias("weight"))
    w = pf.constrain(w, LOW, HIGH, CASH)
    log = ledger.decision_log(cn, vote, reg.layers(wide), w)
    path = _place(spark)
    ledger.export_log(log, path)
    back = spark.read.schema("ts date, final_regime string, risk_on_votes long, risk_off_votes long, regime_layers map<string,string>, "
                             "canaries array<struct<name: string, signal: string>>, portfolio_weights map<string,double>, human_readable string").json(path)
    layer = F.transform(F.array_sort(F.map_entries("regime_layers")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    canary = F.transform("canaries", lambda x: F.concat(x["name"], F.lit(" "), x["signal"]))
    held = F.transform(F.array_sort(F.map_entries("portfolio_weights")), lambda x: F.concat(x["key"], F.lit("="), F.format_string("%.7f", F.round(x["value"], 7))))
    return back.select("ts", "final_regime", "risk_on_votes", "risk_off_votes", F.array_join(layer, ";").alias("layers"),
                       F.array_join(canary, ";").alias("canaries"), F.size("portfolio_weights").cast("bigint").alias("held"),
                       F.array_join(held, ";").alias("weights"), "human_readable")


# ------------------------------------------------------------------ text records

_DOCS = "dc AS (SELECT left(sha256(text || source), 12) AS id, text, source, DATE '2024-01-01' - CAST(doc_id % 700 AS INT) AS published FROM documents)"
_KEYS = ("tion", "ing the", "eau", "und")


def _docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(ledger.content_id(F.col("text"), F.col("source")).alias("id"), "text", "source",
                    F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).alias("published"))


def _points(t: str) -> str:
    base = f"CASE WHEN contains(lower({t}), 'page') THEN coalesce(try_cast(regexp_extract(lower({t}), 'page\\s*([0-9.]+)', 1) AS DOUBLE) * 2, 1.0) ELSE 0.0 END"
    return base + "".join(f" + CASE WHEN contains(lower({t}), '{k}') THEN 0.5 ELSE 0 END" for k in _KEYS) + \
        " + greatest(0, 1 - (DATE '2024-02-01' - published) / 365.0) + CASE WHEN source = 'src3' THEN 0.2 ELSE 0 END"


@query("h7_edge_score", with_(_DOCS) + f"SELECT id, {r('CAST(max(' + _points('text') + ') AS DOUBLE)', 'score')} FROM dc GROUP BY id")
def h7(spark, sf_dir):
    score = tx.edge_score(F.col("text"), F.col("published"), F.col("source"), "2024-02-01", "page", _KEYS, "src3")
    return rounded(_docs(spark, sf_dir).groupBy("id").agg(F.max(score).alias("score")))


@query("h7_daily_top", with_(_DOCS, "un AS (SELECT id, max(text) AS title, max(" + _points("text") + ") AS score FROM dc GROUP BY id)", "sn AS (SELECT id FROM dc WHERE source IN ('src1', 'src2'))") +
       f"SELECT id, {r('CAST(score AS DOUBLE)', 'score')} FROM un WHERE id NOT IN (SELECT id FROM sn) ORDER BY round(CAST(score AS DOUBLE), 9) DESC, title DESC, id LIMIT 20")
def h7b(spark, sf_dir):
    docs = cut(_docs(spark, sf_dir))
    seen = docs.where(F.col("source").isin("src1", "src2")).select("id")
    score = tx.edge_score(F.col("text"), F.col("published"), F.col("source"), "2024-02-01", "page", _KEYS, "src3")
    items = docs.withColumn("_pt", score).groupBy("id").agg(F.max("text").alias("title"), F.max("_pt").alias("_pt"))
    return rounded(tx.daily_top(items, seen, F.col("_pt"), 20).select("id", "score"))


@query("h8_content_id", with_(_DOCS) + "SELECT id, count(*) AS copies FROM dc GROUP BY id")
def h8(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("copies"))


_ROUTES = ("tion the", "eaux", "schen", "und", "ing")


@query("h9_route", "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{k}'" for k in _ROUTES) +
       """ WHEN contains(lower(text), 'sector') AND contains(lower(text), 'momentum') THEN 'sector momentum' WHEN contains(lower(text), 'convex') THEN 'prop firm convex alpha'
  WHEN contains(lower(text), 'prop firm') THEN 'prop firm trading alpha' WHEN contains(lower(text), 'drift') THEN 'positive drift' ELSE 'alpha, trading' END AS template FROM documents""")
def h9(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.route(F.col("text"), _ROUTES).alias("template"))


@query("a11_seen_ledger", with_(_DOCS) + "SELECT DISTINCT id FROM dc WHERE id NOT IN (SELECT id FROM dc WHERE source IN ('src1', 'src2'))")
def a11(spark, sf_dir):
    docs = cut(_docs(spark, sf_dir))
    path = _place(spark)
    ledger.append_seen(docs.where(F.col("source").isin("src1", "src2")), path)
    return ledger.unseen(docs, spark.read.parquet(path), "id").select("id").distinct()


@query("c13_unseen", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def c13(spark, sf_dir):
    return ledger.unseen(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("g4_union_first", with_(_DOCS, "pp AS (SELECT id, 0 AS k, source, text FROM dc WHERE source = 'src4' UNION ALL SELECT id, 1, source, text FROM dc)") +
       "SELECT id, min_by(source, (k, source, text)) AS source FROM pp GROUP BY id")
def g4(spark, sf_dir):
    docs = cut(_docs(spark, sf_dir).select("id", "source", "text"))
    return tx.union_first([docs.where(F.col("source") == "src4"), docs]).select("id", "source")


@query("g1_union_bars", with_(FLAG) + f"SELECT symbol, ts, {r('close')} FROM bars UNION ALL (WITH {BRAND} SELECT symbol, ts, {r('close')} FROM bars)")
def g1(spark, sf_dir):
    a, b = bars_flag(spark, sf_dir), bars_brand(spark, sf_dir)
    return rounded(a.unionByName(b).select("symbol", "ts", "close"))


@query("g2_date_union", with_(FLAG) + "SELECT ts FROM bars UNION (SELECT CAST(o_orderdate AS DATE) FROM orders)")
def g2(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("ts"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("ts")).distinct().union(o.distinct()).distinct()


@query("g3_distinct", "SELECT DISTINCT upper(p_name) AS symbol FROM part")
def g3(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.upper("p_name").alias("symbol")).distinct()


@query("f1_top_and_bottom", with_(MARKET, PANEL, "m AS (SELECT symbol, d, ts, round(close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY d) - 1, 10) AS score FROM panel)",
       "k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, symbol) AS a, row_number() OVER (PARTITION BY d ORDER BY score, symbol) AS b, count(*) OVER (PARTITION BY d) AS n FROM m WHERE score IS NOT NULL)") +
       "SELECT symbol, ts, 'top' AS side FROM k WHERE a <= 3 UNION ALL SELECT symbol, ts, 'bottom' FROM k WHERE b <= greatest(1, n // 4)")
def f1(spark, sf_dir):
    p = panel(bars_market(spark, sf_dir))
    s = feat.compute(p, {"m": feat.momentum(20)})
    s = cut(s.where(F.col("m").isNotNull()).select("symbol", "d", "ts", F.round("m", 10).alias("score")))
    top = rot.pick_top(s, 3).select("symbol", "ts", F.lit("top").alias("side"))
    low = rot.pick_top(s, share=lambda n: F.floor(n / 4), descending=False).select("symbol", "ts", F.lit("bottom").alias("side"))
    return top.unionByName(low)


@query("c10_align_weights", recursive(MARKET, PANEL, *_ENS) + f"SELECT symbol, c.ts, {r('m.w', 'weight')} FROM mix m JOIN cal c USING (d)")
def c10(spark, sf_dir):
    w = rot.all_weights(panel(bars_market(spark, sf_dir)))
    df = w.join(F.broadcast(rot.meta_weights(spark, ENSEMBLE)), "strategy")
    return rounded(df.groupBy("symbol", "ts").agg(F.sum(F.col("weight") * F.col("meta_weight")).alias("weight")))


# ------------------------------------------------------------------------ stream

def _ticks(spark, folder, pattern="events.parquet", files_per_trigger=None):
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    ev = stream.read_ticks(spark, folder, schema, pattern, files_per_trigger)
    return ev.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("seq"))


@query("k1_streaming_bars", with_(HOUR) + f"""SELECT symbol, strftime(ts, '%Y-%m-%d %H') AS hour, {r('open')}, {r('high')}, {r('low')}, {r('close')}, volume FROM bars
  WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def k1(spark, sf_dir):
    place = _place(spark)
    q = stream.write_stream(stream.tick_bars(_ticks(spark, sf_dir)), f"{place}/bars", f"{place}/state")
    q.awaitTermination()
    df = spark.read.parquet(f"{place}/bars")
    return rounded(df.select("symbol", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "open", "high", "low", "close", "volume"))


_KX = """kb AS (SELECT * FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)"""


def _arrivals(spark, sf_dir, place: str, parts: int = 6) -> str:
    """The events as files that arrive one after the other in time order, one micro-batch each."""
    ev = table(spark, sf_dir, "events")
    first, last = ev.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / parts
    for k in range(parts):
        part = ev.where((F.col("ts") >= F.lit(first + k * step)) & ((F.col("ts") < F.lit(first + (k + 1) * step)) | F.lit(k == parts - 1)))
        part.coalesce(1).write.mode("append").parquet(f"{place}/ticks")
    return f"{place}/ticks"


@query("k1_streaming_alerts", with_(HOUR, _KX, *temacd_sql(src="kb"), recursive=True) + f"""SELECT symbol, strftime(ts, '%Y-%m-%d %H') AS hour, {r('close')},
  CASE WHEN long THEN 'LONG ENTRY' ELSE 'SHORT/EXIT' END AS alert, {TREND} AS trend, array_to_string({TRIG}, '; ') AS triggers
  FROM cond WHERE (long OR short) AND i >= 249 AND ema3 IS NOT NULL AND delta IS NOT NULL""")
def k1b(spark, sf_dir):
    place = _place(spark)
    ticks = _ticks(spark, _arrivals(spark, sf_dir, place), "*.parquet", 1)
    q = stream.alert_stream(stream.tick_bars(ticks), f"{place}/known", f"{place}/alerts", f"{place}/state")
    q.awaitTermination()
    df = (spark.read.schema("symbol string, ts timestamp, close double, alert string, trend string, triggers array<string>")
          .option("recursiveFileLookup", True).parquet(f"{place}/alerts"))
    return rounded(df.select("symbol", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "close", "alert", "trend",
                             F.array_join("triggers", "; ").alias("triggers")))
