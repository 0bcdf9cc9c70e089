"""Indexed bar tables the queries start from.

Bars are far smaller than the ticks behind them, so each query reads the raw
tables once, stores its bars with row numbers and works on those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.timeline import index_bars
from barloom.sources import derived


def brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_bars(derived.bars_brand(spark, sf_dir))


def flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_bars(derived.bars_flag(spark, sf_dir))


def hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_bars(derived.bars_hour(spark, sf_dir))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_bars(derived.bars_market(spark, sf_dir))
