"""Result files: screener tables, equity and monthly tables, the daily manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.operators.performance import periodic_returns
from barloom.operators.signals import signal_order


def screener_table(screen: DataFrame) -> DataFrame:
    """Presentable rows: fixed decimals, triggers joined by '; ', LONG then SHORT then HOLD."""
    def fixed(c: str, digits: int):
        return F.format_string(f"%.{digits}f", c).alias(c)
    ordered = screen.orderBy(signal_order(), "symbol")
    return ordered.select("symbol", "signal", "trend", fixed("close", 2), fixed("chg_pct", 2), fixed("delta", 4),
                          fixed("ema1", 2), fixed("ema2", 2), fixed("ema3", 2), F.array_join("triggers", "; ").alias("triggers"),
                          F.date_format("date", "yyyy-MM-dd").alias("date"))


def write_screener(screen: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the screener table as csv (with header) or json."""
    table = screener_table(screen) if fmt == "csv" else screen.orderBy(signal_order(), "symbol")
    writer = table.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def write_equity(curve: DataFrame, path: str, keys=("series_id",)) -> None:
    """Equity with returns, and the monthly returns, as two csv tables."""
    curve.select(*keys, "ts", "equity", "ret").write.mode("overwrite").option("header", True).csv(f"{path}/equity")
    periodic_returns(curve, "month", keys).write.mode("overwrite").option("header", True).csv(f"{path}/monthly")


def manifest(screen: DataFrame, allowed: DataFrame, regime: DataFrame) -> DataFrame:
    """One row: regime, allocation, signal counts, kept longs and shorts.

    ``screen`` is the screener result, ``allowed`` the longs left after the
    regime filter, ``regime`` one row with id, name and allocation. One row per
    symbol enters, the last bar of each.
    """
    kept = allowed.select("symbol", F.lit(True).alias("_kept"))
    df = screen.join(kept, "symbol", "left").agg(
        F.count_if(F.col("signal") == "LONG ENTRY").alias("raw_longs"), F.count_if(F.col("signal") == "SHORT/EXIT").alias("raw_shorts"),
        F.array_sort(F.collect_list(F.when((F.col("signal") == "LONG ENTRY") & F.col("_kept"), F.col("symbol")))).alias("filtered_longs"),
        F.array_sort(F.collect_list(F.when(F.col("signal") == "SHORT/EXIT", F.col("symbol")))).alias("shorts"),
        F.max("date").alias("date"))
    return df.join(F.broadcast(regime), F.lit(True))
