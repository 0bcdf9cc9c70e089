import datetime as dt
import os
import pathlib
import subprocess
import sys

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window, functions as F

from barloom.operators import signals as sig, text as tx
from barloom.schema import as_bars
from barloom.session import cut
from barloom.sources import bars as store, ledger, tickers
from barloom.streaming import bars as stream
from tests.conftest import collect


def test_store_round_trip_prunes_and_merges(spark, bars, tmp_path):
    path = str(tmp_path / "bars")
    store.write_bars(bars, path)
    assert store.scan_bars(spark, path).count() == bars.count()
    part = store.scan_bars(spark, path, "2000-02-01", "2000-02-10", ["A"])
    assert part.count() == 10
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [" in plan
    fresh = bars.where((F.col("symbol") == "A") & (F.col("ts") < F.lit("2000-01-10").cast("date"))).withColumn("close", F.lit(1.0))
    store.update_store(spark, path, fresh)
    again = store.scan_bars(spark, path)
    assert again.count() == bars.count() and again.where(F.col("close") == 1.0).count() == fresh.count()


def test_store_files_follow_rows_and_hold_few_symbols(spark, bars, tmp_path):
    few, many = str(tmp_path / "few"), str(tmp_path / "many")
    store.write_bars(bars, few)
    store.write_bars(bars, many, rows_per_file=100)
    years, n = 2, bars.count()
    files = [sorted(pathlib.Path(p).glob("year=*/*.parquet")) for p in (few, many)]
    assert len(files[0]) == years and n / 100 <= len(files[1]) <= n / 60 + years
    held = [pq.read_metadata(f).row_group(0) for f in files[1]]
    stats = [{g.column(k).path_in_schema: g.column(k).statistics for k in range(g.num_columns)}["symbol"] for g in held]
    assert sum(s.min <= "B" <= s.max for s in stats) < len(stats) / 2  # a query for one symbol opens few files
    assert store.scan_bars(spark, many, symbols=["B"]).count() == bars.where("symbol = 'B'").count()
    before = {f: f.stat().st_mtime_ns for f in files[1] if "year=2000" in str(f)}
    store.update_store(spark, many, bars.where("ts >= '2001-01-01'"))
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())  # untouched years keep their files


def test_as_bars_fills_and_casts(spark):
    df = spark.sql("SELECT 'A' AS symbol, TIMESTAMP_NTZ '2020-01-01 10:00:00' AS ts, CAST('NaN' AS DOUBLE) AS high, 5.0 AS close")
    row = as_bars(df).first()
    assert row.high == 5.0 and row.volume is None and row.ts == dt.datetime(2020, 1, 1, 10)
    with pytest.raises(ValueError):
        as_bars(spark.sql("SELECT 'A' AS symbol"))


def test_tickers(spark, tmp_path):
    f = tmp_path / "t.txt"
    f.write_text("# comment\nspy, qqq  brk.b\n\nspy ^vix btc-usd bad$one waytoolongtickersymbol1\nmes=f\n")
    assert [r.symbol for r in tickers.read_tickers(spark, str(f)).collect()] == ["BRK.B", "BTC-USD", "MES=F", "QQQ", "SPY", "^VIX"]


def test_registry_rejects_overlap_and_repeats(spark, tmp_path):
    cols = "experiment_id string, train_period string, test_period string, hypothesis string"
    good = spark.createDataFrame([("e1", "2000-01-01 to 2001-01-01", "2001-02-01 to 2002-01-01", "slow capital keeps trends alive")], cols)
    bad = spark.createDataFrame([("e2", "2000-01-01 to 2001-03-01", "2001-02-01 to 2002-01-01", "slow capital keeps trends alive")], cols)
    path = str(tmp_path / "reg")
    assert ledger.register(good, path).count() == 1 and ledger.register(good, path).count() == 0
    with pytest.raises(ValueError):
        ledger.register(bad, path)
    with pytest.raises(ValueError):
        ledger.register(good.withColumn("hypothesis", F.lit("short")), path)


def test_text_scoring_and_routing(spark):
    df = spark.createDataFrame([("1", "Sharpe 2.5 with alpha", None, "SSRN"), ("2", "Overnight drift and PEAD", None, "x"), ("3", "nothing", None, "x")],
                               "id string, text string, published date, source string")
    got = {r.id: r for r in df.select("id", tx.edge_score(F.col("text"), F.col("published"), F.col("source"), "2024-01-01").alias("s"), tx.route(F.col("text")).alias("t")).collect()}
    assert got["1"].s == pytest.approx(5.0 + 1.0 + 1.0 + 0.2) and got["2"].s == pytest.approx(1.0 + 1.0) and got["3"].s == pytest.approx(1.0)
    assert got["2"].t == "pead" and got["3"].t == "alpha, trading"


def test_cut_keeps_rows_and_is_idempotent(bars):
    a = cut(bars)
    assert cut(a) is a and a.count() == bars.count()


def test_stream_drops_late_ticks_and_keeps_open_bars_back(spark, tmp_path):
    src, schema = tmp_path / "in", "symbol string, ts timestamp, price double, seq long"
    base = dt.datetime(2024, 1, 1)

    def feed(rows, name):
        spark.createDataFrame([(s, base + dt.timedelta(minutes=m), p, i) for s, m, p, i in rows], schema).coalesce(1).write.parquet(str(src / name))

    def run():
        ticks = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src))
        stream.write_stream(stream.tick_bars(ticks), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return collect(spark.read.parquet(str(tmp_path / "out")), "ts")
    feed([("A", 5, 1.0, 1), ("A", 50, 3.0, 2), ("A", 75, 2.0, 3), ("A", 140, 9.0, 4)], "a")
    first = run()
    assert first[["open", "high", "low", "close", "volume"]].values.tolist() == [[1.0, 3.0, 1.0, 3.0, 2.0], [2.0, 2.0, 2.0, 2.0, 1.0]]
    feed([("A", 10, 100.0, 5), ("A", 300, 4.0, 6)], "b")
    second = run()
    assert len(second) == 3 and second.high.max() == 9.0  # the tick of minute 10 came too late


def screener_rows(bars, p, min_bars):
    df = sig.temacd_conditions(bars, p).withColumn("_i", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)
    return {(r.symbol, r.ts) for r in df.where((F.col("long") | F.col("short")) & sig.complete(min_bars)).collect()}


def test_alerts_carry_state_over_batches_and_ignore_repeats(spark, bars, tmp_path):
    """Bars in uneven batches, a symbol that pauses, repeats of old bars: the alerts of the whole history, each once."""
    p = sig.TripleEma(3, 8, 21, 6, 10, 4)
    bars = bars.withColumn("ts", F.col("ts").cast("timestamp"))
    want = screener_rows(bars, p, 30)
    folder, schema = str(tmp_path / "in"), "symbol string, ts timestamp, close double, volume double"
    cols = bars.select("symbol", "ts", "close", "volume")
    borders = ["1999-01-01", "2000-01-05", "2000-01-06", "2000-04-01", "2000-04-15", "2001-01-01", "2005-01-01"]

    def run():
        stream_in = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        stream.alert_stream(stream_in, str(tmp_path / "state"), str(tmp_path / "alerts"), str(tmp_path / "cp"), p, 30).awaitTermination()

    for a, b in zip(borders[:-1], borders[1:]):
        part = cols.where((F.col("ts") >= a) & (F.col("ts") < b) & ~((F.col("symbol") == "B") & (F.col("ts") >= "2000-04-01") & (F.col("ts") < "2000-04-15")))
        if b == "2001-01-01":
            part = part.unionByName(cols.where((F.col("ts") >= "2000-03-20") & (F.col("ts") < "2000-04-01")).withColumn("close", F.lit(1.0)))
        part.coalesce(1).write.mode("append").parquet(folder)
        if b in ("2000-04-15", "2005-01-01"):
            run()  # a restart in the middle
    paused = bars.where(~((F.col("symbol") == "B") & (F.col("ts") >= "2000-04-01") & (F.col("ts") < "2000-04-15")))
    want = screener_rows(paused, p, 30)
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "alerts")).collect()
    assert len(got) == len(want) > 50 and {(r.symbol, r.ts) for r in got} == want
    assert all(r.triggers != ["-"] for r in got)
    assert len(list((tmp_path / "state").glob("batch=*"))) == 2


def test_step_continues_where_the_state_ends(spark, bars):
    p = sig.TripleEma(3, 8, 21, 6, 10, 4)
    none = spark.createDataFrame([], stream.STATE)
    cols = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close")
    whole, end = sig.temacd_step(cols, none, p)
    plain = collect(sig.temacd_conditions(cols, p), "symbol", "ts")
    whole = collect(whole, "symbol", "ts")
    for c in ("ema1", "ema2", "ema3", "macd", "amacd", "delta"):
        known = plain[c].notna()
        assert (whole[c].notna() == known).all() or c == "macd"
        np.testing.assert_allclose(whole[c][known], plain[c][known], rtol=1e-9, atol=1e-9)
    first, state = sig.temacd_step(cols.where(F.col("ts") < "2000-12-01"), none, p)
    second, again = sig.temacd_step(cols.where(F.col("ts") >= "2000-12-01"), cut(state), p)
    both = collect(first.unionByName(second), "symbol", "ts")
    np.testing.assert_allclose(both.delta.dropna(), whole.delta.dropna(), rtol=1e-8, atol=1e-9)
    assert (both.long == whole.long).all() and (both.short == whole.short).all() and (both._i == whole._i).all()
    a, b = collect(end, "symbol"), collect(again, "symbol")
    assert a._i.tolist() == b._i.tolist() and a.ts.tolist() == b.ts.tolist()


def test_work_folder_needs_no_configuration(tmp_path):
    """A plain local session without any Spark configuration stores its tables in a temporary folder."""
    code = ("from barloom.session import build_session, cut\ns = build_session('t', '1', 1, '1g')\n"
            "assert s.conf.get('spark.checkpoint.dir', None) is None\nprint(cut(s.range(5)).count(), cut(s.range(3)).count())")
    env = {k: v for k, v in os.environ.items() if k != "SPARK_CONF_DIR"} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.split() == ["5", "3"]
