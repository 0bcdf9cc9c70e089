"""As-of and interval joins on series tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.operators.timeline import index_bars, scan, time_block
from barloom.session import cut


def _asof(left: DataFrame, right: DataFrame, by, on: str, days: float, forward: bool) -> DataFrame:
    """As-of match by union and running last value: linear, and no pair of rows is formed.

    Only the distinct (by, on) of the left side take part, so a key with many
    left rows costs no more than its distinct times; the match is then joined
    back, where one row per key meets any number of left rows.
    """
    by = list(by)
    rcols = [c for c in right.columns if c not in [*by, on]]
    asked = left.select(*by, on).distinct().withColumn("_side", F.lit(1))
    known = right.select(*by, on, F.struct(F.col(on).alias("_m"), *rcols).alias("_r")).withColumn("_side", F.lit(0))
    both = asked.unionByName(known, allowMissingColumns=True)
    # forward is the same scan on a reversed time key; at equal times the right row comes first
    at, block = F.col(on), time_block(on, days)
    if forward:
        at, block = -F.unix_micros(at.cast("timestamp")), -block
    both = cut(both.withColumn("_o", F.struct(at.alias("t"), F.col("_side").alias("s"))))
    hit = scan(both, {"_hit": ("last", F.col("_r"))}, by, "_o", block).where(F.col("_side") == 1)
    hit = hit.select(*by, on, F.col("_hit._m").alias(f"matched_{on}"), *[F.col(f"_hit.{c}").alias(c) for c in rcols])
    return left.join(hit, [*by, on], "left")


def asof_backward(left: DataFrame, right: DataFrame, by=("symbol",), on: str = "ts", days: float = 16) -> DataFrame:
    """Each left row with the newest right row at or before it (NULLs if none)."""
    return _asof(left, right, by, on, days, False)


def asof_forward(left: DataFrame, right: DataFrame, by=("symbol",), on: str = "ts", days: float = 16) -> DataFrame:
    """Each left row with the first right row at or after it (NULLs if none)."""
    return _asof(left, right, by, on, days, True)


def execution_prices(orders: DataFrame, bars: DataFrame, delay: int = 1, price: str = "open", slippage_bps: float = 2.0,
                     commission_fixed: float = 0.0, commission_pct: float = 0.0005) -> DataFrame:
    """Fill price and cost of orders(symbol, ts, order_id, side, quantity).

    The fill bar is ``delay`` bars after the first bar at or after the order;
    orders without such a bar are dropped.
    """
    b = bars if "_i" in bars.columns else index_bars(bars)
    entry = asof_forward(orders, b.select("symbol", "ts", "_i"))
    fills = b.select("symbol", F.col("_i").alias("_fill"), F.col("ts").alias("fill_ts"), F.col(price).alias("raw_price"))
    df = entry.withColumn("_fill", F.col("_i") + delay).join(fills, ["symbol", "_fill"])
    sign = F.when(F.upper("side") == "BUY", 1.0).otherwise(-1.0)
    df = df.withColumn("exec_price", F.col("raw_price") * (F.lit(1.0) + sign * slippage_bps / 10000.0))
    cost = F.abs(F.col("quantity")) * commission_fixed + F.abs(F.col("quantity") * F.col("exec_price")) * commission_pct
    return df.withColumn("commission", cost).drop("_i", "_fill", "matched_ts")


def join_windows(df: DataFrame, windows: DataFrame, start: str = "start", end: str = "end", on: str = "ts") -> DataFrame:
    """Rows inside each window [start, end] (inclusive dates).

    Windows are listed under the months they cover and joined on the month, an
    equi-join that Spark broadcasts or shuffles by the real size.
    """
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    listed = windows.withColumn("_month", F.explode(months))
    rows = df.withColumn("_month", F.trunc(on, "month"))
    day = F.col(on).cast("date")
    return rows.join(listed, "_month").where((day >= F.col(start)) & (day <= F.col(end))).drop("_month")


def first_available(candidates: DataFrame, available: DataFrame, key: str, need: list[str], priority: str = "prio") -> DataFrame:
    """First candidate per key whose needed symbols are all available ('' needs nothing)."""
    df = candidates
    for c in need:
        have = available.select(F.col("symbol").alias(c)).withColumn(f"_ok_{c}", F.lit(True))
        df = df.join(have, c, "left").where((F.col(c) == "") | F.col(f"_ok_{c}")).drop(f"_ok_{c}")
    others = [c for c in candidates.columns if c != key]
    top = df.groupBy(key).agg(F.min_by(F.struct(*others), priority).alias("_c"))
    return top.select(key, *[F.col(f"_c.{c}").alias(c) for c in others])
