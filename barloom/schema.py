"""Canonical schemas and the checks every operator can rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

BARS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

PRICE_COLUMNS = ("open", "high", "low", "close", "volume")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail early when an input lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def as_bars(df: DataFrame) -> DataFrame:
    """Cast any bar-like frame to the canonical column set.

    Zone-free stamps become session-zone (UTC) timestamps, DATE stays DATE,
    NaN becomes NULL, and a missing high, low or open falls back to close.
    """
    require(df, "symbol", "ts", "close")
    kinds = dict(df.dtypes)
    ts = F.col("ts")
    if kinds["ts"] not in ("date", "timestamp"):
        ts = ts.cast("timestamp")

    def price(name: str):
        if name not in df.columns:
            return F.lit(None).cast("double") if name == "volume" else price("close")
        value = F.col(name).cast("double")
        value = F.when(~F.isnan(value), value)
        return value if name in ("close", "volume") else F.coalesce(value, price("close"))

    return df.select(
        F.col("symbol").cast("string").alias("symbol"), ts.alias("ts"),
        *[price(c).alias(c) for c in PRICE_COLUMNS],
    )
