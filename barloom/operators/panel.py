"""Calendar panel: every symbol on every date since its first bar, filled forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.operators.timeline import attach, number, scan
from barloom.schema import PRICE_COLUMNS
from barloom.session import cut


def calendar(bars: DataFrame) -> DataFrame:
    """Distinct dates with a dense index ``d``."""
    return number(bars.select("ts").distinct(), keys=()).withColumnRenamed("_i", "d")


def panel(bars: DataFrame, columns=PRICE_COLUMNS) -> DataFrame:
    """symbol, ts, d, columns..., plus ``_i`` (row number) and ``_pc`` (close before).

    Each bar is repeated over the dates until the symbol's next bar, so no
    date-by-symbol product is built and no series is filled in one task.
    ``d`` is the calendar index; shifting by one calendar bar is ``d + 1``.
    """
    bars = cut(bars)
    cal = cut(calendar(bars))
    size = cal.agg((F.max("d") + 1).alias("_end"))
    cols = [c for c in columns if c in bars.columns]
    df = bars.select("symbol", "ts", *cols).join(cal, "ts")
    df = scan(df, {"_next": ("next", F.col("d")), "_pc": ("prev", F.col("close"))}, order="d",
              block=F.floor(F.col("d") / 512))
    first = bars.groupBy("symbol").agg(F.min("ts").alias("ts")).join(cal, "ts").select(
        "symbol", F.col("d").alias("_d0"))
    df = attach(df, size).join(first, "symbol")
    last = F.coalesce(F.col("_next"), F.col("_end")) - 1
    df = df.withColumn("_at", F.explode(F.sequence(F.col("d"), last)))
    before = F.when(F.col("_at") == F.col("d"), F.col("_pc")).otherwise(F.col("close"))
    df = df.select("symbol", *cols, before.alias("_pc"), F.col("_at").alias("d"),
                   (F.col("_at") - F.col("_d0")).alias("_i"))
    return cut(df.join(cal, "d").select("symbol", "ts", "d", *cols, "_i", "_pc"))


def panel_returns(p: DataFrame) -> DataFrame:
    """Simple returns on the panel (0 on filled dates, NULL on the first)."""
    return p.select("symbol", "ts", "d", (F.try_divide("close", "_pc") - 1).alias("ret"))


def next_bar(weights: DataFrame, cal: DataFrame) -> DataFrame:
    """Apply weights decided on date ``d`` from the next calendar date on."""
    shifted = weights.withColumn("d", F.col("d") + 1)
    return shifted.drop("ts").join(cal, "d")
