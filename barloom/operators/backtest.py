"""Positions from signals and vectorised backtests, free of row loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.scalars import change
from barloom.operators import features as feat
from barloom.operators.timeline import index_bars, pick, scan, time_block
from barloom.session import cut


def hold_position(conds: DataFrame) -> DataFrame:
    """Position 1 from a long until a short; long wins a bar with both."""
    event = F.when(F.col("long"), 1).when(F.col("short"), 0)
    out = scan(conds, {"position": ("last", event)})
    return out.withColumn("position", F.coalesce(F.col("position"), F.lit(0)))


def state_position(conds: DataFrame, short_state: int = 0) -> DataFrame:
    """Three-state machine: long enters unless long, short leaves unless short.

    A bar on which only one fires sets the state outright. Bars on which both
    fire flip it, so the state is the last outright one and the parity of
    both-bars since then.
    """
    lo, sh = F.col("long"), F.col("short")
    df = cut(conds.select("symbol", "ts", "close", "long", "short")).withColumns({
        "_tb": time_block(),
        "_one": lo != sh, "_both": lo & sh})
    state = F.when(F.col("_one"), F.when(lo, 1).otherwise(short_state))
    df = scan(df, {"_base": ("last", state), "_nb": ("sum", F.col("_both").cast("int"))})
    df = scan(df, {"_at": ("last", F.when(F.col("_one"), F.col("_nb")))})
    base = F.coalesce(F.col("_base"), F.lit(0))
    flips = F.col("_nb") - F.coalesce(F.col("_at"), F.lit(0))
    odd = flips % 2 == 1
    pos = F.when(flips == 0, base).when(odd == (base <= 0), 1).otherwise(short_state)
    return df.withColumn("position", pos.cast("int")).drop("_tb", "_one", "_both", "_base", "_nb", "_at")


def strategy_returns(positions: DataFrame, cost: float = 0.0005, capital: float = 100000.0,
                     keys=("symbol",)) -> DataFrame:
    """Next-bar returns of a position, less cost per unit of position change.

    Adds ``asset_ret``, ``turnover``, ``ret`` and ``equity``.
    """
    df = cut(positions).withColumn("_tb", time_block())
    df = scan(df, {"_pc": ("prev", F.col("close")), "_pp": ("prev", F.col("position"))}, keys)
    df = df.withColumns({
        "asset_ret": F.coalesce(change(F.col("close"), F.col("_pc")), F.lit(0.0)),
        "turnover": F.coalesce(F.abs(F.col("position") - F.col("_pp")), F.lit(0)).cast("double")})
    df = df.withColumn("ret", F.coalesce(F.col("_pp"), F.lit(0)) * F.col("asset_ret") - F.col("turnover") * cost)
    df = scan(df, {"equity": ("product", F.lit(1.0) + F.col("ret"))}, keys)
    return df.withColumn("equity", F.col("equity") * capital).drop("_pc", "_pp", "_tb")


def equity_curve(rets: DataFrame, keys=("series_id",), ret: str = "ret", capital: float = 1.0) -> DataFrame:
    """capital times the running product of 1 + ret; missing returns count as 0."""
    df = scan(rets, {"equity": ("product", F.lit(1.0) + F.coalesce(F.col(ret), F.lit(0.0)))}, keys)
    return df.withColumn("equity", F.col("equity") * capital)


def closed_trades(positions: DataFrame, strategy: str = "TEMACD") -> DataFrame:
    """Closed round trips of a position column (1 long, -1 short, 0 flat)."""
    df = scan(cut(positions), {"_pp": ("prev", F.col("position")), "_bar": ("count", F.lit(1))})
    turns = cut(df.where(F.col("position") != F.coalesce(F.col("_pp"), F.lit(0))))
    turns = scan(turns, {"exit_ts": ("next", F.col("ts")), "exit_px": ("next", F.col("close")),
                         "_xb": ("next", F.col("_bar"))})
    side = F.when(F.col("position") == 1, "long").otherwise("short")
    move = F.when(F.col("position") == 1, F.col("exit_px") - F.col("close")).otherwise(
        F.col("close") - F.col("exit_px"))
    return turns.where((F.col("position") != 0) & F.col("exit_ts").isNotNull()).select(
        "symbol", F.lit(strategy).alias("strategy"), side.alias("side"), F.col("ts").alias("entry_ts"),
        "exit_ts", F.col("close").alias("entry_px"), "exit_px",
        (F.col("_bar") - 1).alias("entry_bar"), (F.col("_xb") - 1).alias("exit_bar"),
        F.try_divide(move, F.col("close")).alias("pnl_pct"))


def trade_metrics(trades: DataFrame, by=("symbol",)) -> DataFrame:
    p = F.col("pnl_pct")
    win, loss = F.when(p > 0, p), F.when(p <= 0, p)
    return trades.groupBy(*by).agg(
        (F.count(win) / F.count(p) * 100).alias("win_rate"),
        F.try_divide(F.coalesce(F.sum(win), F.lit(0.0)), F.abs(F.sum(loss))).alias("profit_factor"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.count(p).alias("num_trades"), F.sum(p).alias("total_pnl"))


def donchian_hold(bars: DataFrame, entry: int = 20, exit: int = 10, high: str = "high", low: str = "low") -> DataFrame:
    """Long from a close over the previous channel top until a close under its bottom."""
    need = dict.fromkeys([high, low, "close"])
    df = cut(feat.compute(pick(bars, *need), {"don": feat.donchian(entry, exit, high, low)}))
    conds = df.withColumns({
        "long": F.coalesce(F.col("close") > F.col("don_upper"), F.lit(False)),
        "short": F.coalesce(F.col("close") < F.col("don_lower"), F.lit(False))})
    return hold_position(conds).drop("long", "short")


def continuous_allocation(bars: DataFrame, fast: int = 32, slow: int = 128, max_leverage: float = 5.0,
                          capital: float = 100000.0) -> DataFrame:
    """Forecast-sized, breakout and blended allocations with their equity curves."""
    bars = bars if "_pc" in bars.columns else index_bars(bars)
    df = feat.compute(pick(bars, "close"), {"don": feat.donchian(20, 10, "close", "close"),
                                            "_av": feat.rolling_volatility(25)}, keep_index=True)
    df = cut(df.withColumns({"long": F.col("close") > F.col("don_upper"), "short": F.col("close") < F.col("don_lower")}))
    df = hold_position(df).withColumnRenamed("position", "donchian_allocation").drop(
        "don_upper", "don_lower", "long", "short")
    df = cut(feat.ewmac(df, fast, slow))
    alloc = F.greatest(F.lit(-max_leverage), F.least(F.lit(max_leverage), F.col("forecast") / 10.0))
    df = df.withColumns({"asset_vol": F.coalesce(F.col("_av"), F.lit(0.5)), "carver_allocation": alloc})
    df = df.withColumn("blended_allocation", F.lit(0.5) * F.col("carver_allocation") + F.col("donchian_allocation"))
    kinds = ("carver", "donchian", "blended")
    df = df.drop("_av").withColumn("_tb", time_block())
    df = scan(df, {"_pc": ("prev", F.col("close")),
                   **{f"_p{k}": ("prev", F.col(f"{k}_allocation")) for k in kinds}})
    r = F.coalesce(change(F.col("close"), F.col("_pc")), F.lit(0.0))
    df = scan(df, {f"equity_{k}": ("product", F.lit(1.0) + r * F.coalesce(F.col(f"_p{k}"), F.lit(0)))
                   for k in kinds})
    return df.withColumns({f"equity_{k}": F.col(f"equity_{k}") * capital for k in kinds}).drop(
        "_pc", "_tb", *[f"_p{k}" for k in kinds])


def buy_and_hold(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        change(F.max_by("close", "ts"), F.min_by("close", "ts")).alias("buy_hold_return"))


def contracts(equity: Column, close: Column, leverage: float = 1.0) -> Column:
    return F.try_divide(equity, close) * leverage


def lots(capital: Column, target_vol: float, asset_vol: Column, price: Column, multiplier: Column) -> Column:
    """Volatility-sized lots; 0 when volatility or price is not positive."""
    size = F.try_divide(capital * target_vol, asset_vol * price * multiplier)
    return F.when((asset_vol > 0) & (price > 0), size).otherwise(0.0)
