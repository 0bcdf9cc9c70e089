"""Bars built from generic tick-like tables (the test inputs have no prices)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: symbol names given to the 25 brands, in brand order
ROLES = ("SPY QQQ TQQQ IWM XLU XLP XLV XLE XLB XLI XLK XLF XLY GLD TLT IEF BIL HYG LQD UUP "
         "TIP VIXY SHY DBC USMV").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(ticks: DataFrame, price: Column, key: Column, volume: Column) -> DataFrame:
    """Aggregate ticks(symbol, ts) to bars; ``key`` orders ticks inside a bar.

    All five aggregates combine map-side, so a hot symbol or day is reduced
    before the shuffle.
    """
    return ticks.groupBy("symbol", "ts").agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"),
        F.min(price).alias("low"), F.max_by(price, key).alias("close"),
        volume.alias("volume"),
    )


def _line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_returnflag", "l_linestatus", "l_quantity",
        F.col("l_shipdate").cast("date").alias("ts"),
        (F.lit(100) + F.col("l_extendedprice") / F.lit(10000)).alias("px"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"),
    )


def bars_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per part brand: 25 symbols with gaps."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    ticks = _line_ticks(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return ohlcv(ticks, F.col("px"), F.col("k"), F.sum("l_quantity"))


def bars_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per return flag and line status: 6 symbols, long history."""
    ticks = _line_ticks(spark, sf_dir).withColumn("symbol", F.concat("l_returnflag", "l_linestatus"))
    return ohlcv(ticks, F.col("px"), F.col("k"), F.sum("l_quantity"))


def bars_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type, with TIMESTAMP stamps."""
    ev = table(spark, sf_dir, "events")
    ticks = ev.select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("hour", F.col("ts")).cast("timestamp").alias("ts"),
        F.col("value").alias("px"), F.struct("ts", "event_id").alias("k"))
    return ohlcv(ticks, F.col("px"), F.col("k"), F.count(F.lit(1)).cast("double"))


def bars_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand bars under market symbol names; the volatility index is rescaled."""
    bars = bars_brand(spark, sf_dir)
    nth = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    bars = bars.withColumn("symbol", F.element_at(F.array(*[F.lit(r) for r in ROLES]), nth))
    is_vix = F.col("symbol") == "VIXY"

    def scaled(c: str) -> Column:
        return F.when(is_vix, F.lit(12) + F.lit(2) * (F.col(c) - F.lit(100))).otherwise(F.col(c)).alias(c)

    return bars.select("symbol", "ts", *[scaled(c) for c in ("open", "high", "low", "close")], "volume")
