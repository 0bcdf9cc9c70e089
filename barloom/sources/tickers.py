"""Ticker lists: cleaning and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TICKER = r"^[A-Z0-9\.\-\^/=]+$"  # fixed value: characters a ticker may hold


def clean_tickers(df: DataFrame, column: str = "symbol", max_length: int = 20) -> DataFrame:
    """Trimmed, upper-cased, valid, distinct tickers in order."""
    t = F.upper(F.trim(F.col(column)))
    return (df.select(t.alias("symbol")).where((F.length("symbol") <= max_length) & F.col("symbol").rlike(TICKER))
            .distinct().orderBy("symbol"))


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """Tickers of a text file: '#' lines are comments, commas and spaces separate."""
    line = F.trim("value")
    words = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    return clean_tickers(words.select(F.explode(F.split("value", r"[,\s]+")).alias("symbol")))
