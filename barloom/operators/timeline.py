"""Series operators that never need a whole series in one task.

A plain ``Window.partitionBy(symbol)`` puts all history of one symbol in one
task, which fails when a single symbol holds a third of the table. Here every
series is split along time, and each operator combines the pieces exactly:

* ``scan``        running aggregates and lag/lead: per-block windows plus a
                  small table of block totals.
* ``number``      dense row numbers per series, a ``scan`` of a count.
* ``blocks``      fixed-size row blocks; each block carries the few earlier
                  (later) rows its rolling frames reach into.
* ``linear_scan`` first-order recurrences s = beta * s_prev + u (EMA family).

Only the block tables (rows / block size) ever pass a per-series window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from barloom.session import cut

BLOCK_DAYS = 512      # width of a time block in scan()
BLOCK_ROWS = 2048     # rows owned by a block in blocks()
EMA_ROWS = 256        # beta ** -256 stays inside double range for span >= 2

_COMBINE = {"sum", "count", "max", "min", "product", "last", "prev", "next"}


def time_block(order: str = "ts", days: float = BLOCK_DAYS) -> Column:
    """Block number of a DATE or TIMESTAMP column; fractions of a day are allowed."""
    if days != int(days):
        return F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / F.lit(max(1, int(86400 * days))))
    return F.floor(F.unix_date(F.col(order).cast("date")) / F.lit(days)).cast("int")


def scan(df: DataFrame, specs: dict[str, tuple[str, Column]], keys=("symbol",),
         order: str = "ts", block: Column | None = None) -> DataFrame:
    """Add running columns to ``df``.

    ``specs`` maps a new column to ``(kind, expression)``; kinds are running
    (inclusive) ``sum count max min product last`` and ``prev``/``next`` (the
    neighbouring row's value). ``block`` must be non-decreasing in ``order``.
    A ``_tb`` column already there is used and kept, so chained scans share one
    shuffle.
    """
    keys = list(keys)
    unknown = {k for k, _ in specs.values()} - _COMBINE
    if unknown:
        raise ValueError(f"unknown scan kinds {unknown}")
    base = df if "_tb" in df.columns else df.withColumn("_tb", time_block(order) if block is None else block)
    part = Window.partitionBy(*keys, "_tb").orderBy(order)
    run = part.rowsBetween(Window.unboundedPreceding, 0)
    ends_w = Window.partitionBy(*keys).orderBy("_tb")
    before = ends_w.rowsBetween(Window.unboundedPreceding, -1)

    per_block, local, carry, final = [], {}, {}, {}
    edge = {}
    for name, (kind, expr) in specs.items():
        t, c, loc = f"_t_{name}", f"_c_{name}", f"_l_{name}"
        if kind in ("sum", "count", "max", "min", "product"):
            fn = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min,
                  "product": F.product}[kind]
            per_block.append(fn(expr).alias(t))
            local[loc] = fn(expr).over(run)
            again = F.sum if kind == "count" else fn
            carry[c] = again(F.col(t)).over(before)
            if kind in ("sum", "count"):
                joined = F.coalesce(F.col(loc), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))
            elif kind == "product":
                joined = F.coalesce(F.col(loc), F.lit(1.0)) * F.coalesce(F.col(c), F.lit(1.0))
            else:
                joined = (F.greatest if kind == "max" else F.least)(F.col(loc), F.col(c))
            final[name] = joined
        elif kind == "last":
            per_block.append(F.max_by(expr, F.when(expr.isNotNull(), F.col(order))).alias(t))
            local[loc] = F.last(expr, ignorenulls=True).over(run)
            carry[c] = F.last(F.col(t), ignorenulls=True).over(before)
            final[name] = F.coalesce(F.col(loc), F.col(c))
        elif kind == "prev":
            per_block.append(F.max_by(expr, F.col(order)).alias(t))
            local[loc] = F.lag(expr).over(part)
            edge["_first"] = F.row_number().over(part)
            carry[c] = F.lag(F.col(t)).over(ends_w)
            final[name] = F.when(F.col("_first") == 1, F.col(c)).otherwise(F.col(loc))
        else:
            per_block.append(F.min_by(expr, F.col(order)).alias(t))
            local[loc] = F.lead(expr).over(part)
            edge["_is_end"] = F.lead(F.lit(1)).over(part)
            carry[c] = F.lead(F.col(t)).over(ends_w)
            final[name] = F.when(F.col("_is_end").isNull(), F.col(c)).otherwise(F.col(loc))

    ends = base.groupBy(*keys, "_tb").agg(*per_block)
    ends = ends.select(*keys, "_tb", *[x.alias(n) for n, x in carry.items()])
    out = base.withColumns({**local, **edge}).join(ends, [*keys, "_tb"])
    keep = [c for c in df.columns if c not in final]
    return out.select(*keep, *[x.alias(n) for n, x in final.items()])


def number(df: DataFrame, keys=("symbol",), order: str = "ts", days: int = BLOCK_DAYS) -> DataFrame:
    """Add ``_i``, the 0-based row number per series; kept if already there."""
    if "_i" in df.columns:
        return df
    out = scan(df, {"_i": ("count", F.lit(1))}, keys, order, time_block(order, days))
    return out.withColumn("_i", F.col("_i") - 1)


def block_days(df: DataFrame, keys=("symbol",), order: str = "ts", rows: int = BLOCK_ROWS) -> float:
    """Width of a time block in which the densest series has about ``rows`` rows, at most BLOCK_DAYS.

    Dates have at most one row a day and need no look at the data.
    """
    if df.schema[order].dataType == T.DateType():
        return BLOCK_DAYS
    day = F.unix_seconds(F.col(order).cast("timestamp")) / 86400.0
    density = df.groupBy(*keys).agg((F.count(F.lit(1)) / (F.max(day) - F.min(day) + 1 / 24)).alias("_d")).agg(F.max("_d")).first()[0]
    return BLOCK_DAYS if not density else float(min(BLOCK_DAYS, max(1 / 1440, rows / density)))


def index_bars(bars: DataFrame, keys=("symbol",), order: str = "ts", price: str = "close") -> DataFrame:
    """Store a series table once with its row number ``_i`` and previous price ``_pc``.

    Every block operator needs row numbers and most need the previous close;
    with both in the table they cost one pass for any number of operators. Blocks
    are as narrow as intraday bars need.
    """
    base = cut(bars)
    out = scan(base, {"_i": ("count", F.lit(1)), "_pc": ("prev", F.col(price))}, keys, order, time_block(order, block_days(base, keys, order)))
    return cut(out.withColumn("_i", F.col("_i") - 1).drop("_tb"))


def pick(df: DataFrame, *columns: str, keys=("symbol",), order: str = "ts") -> DataFrame:
    """Narrow a series table to ``columns``, keeping its index columns."""
    index = [c for c in ("_i", "_pc") if c in df.columns]
    return df.select(*keys, order, *columns, *index)


def blocks(df: DataFrame, lookback: int, lookahead: int = 0, size: int = BLOCK_ROWS,
           keys=("symbol",), order: str = "ts") -> DataFrame:
    """Split numbered series into row blocks with history attached.

    Adds ``_b`` (block) and ``_own`` (row belongs to the block; the others are
    history). Rolling frames of up to ``lookback`` earlier rows are exact on
    ``_own`` rows of ``window()``.
    """
    out = number(df, keys, order)
    mine = F.floor(F.col("_i") / F.lit(size))
    if lookback == 0 and lookahead == 0:
        return out.withColumns({"_b": mine, "_own": F.lit(True)})
    first = F.greatest(F.lit(0), F.floor((F.col("_i") - F.lit(lookahead)) / F.lit(size)))
    last = F.floor((F.col("_i") + F.lit(lookback)) / F.lit(size))
    return (
        out.withColumn("_b", F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col("_b") == mine)
    )


def window(keys=("symbol",)) -> WindowSpec:
    return Window.partitionBy(*keys, "_b").orderBy("_i")


def own(df: DataFrame, drop_index: bool = True) -> DataFrame:
    """Keep owned rows and drop the block columns."""
    extra = ["_b", "_own", "_p"] + (["_i", "_pc"] if drop_index else [])
    return df.where("_own").drop(*extra)


def full(agg: Column, x: Column, n: int, w: WindowSpec) -> Column:
    """Rolling aggregate that is NULL until ``n`` non-null values are present.

    ``agg`` must be an unbound aggregate expression.
    """
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg.over(frame))


# ---------------------------------------------------------------- recurrences

def ema_blocks(df: DataFrame, keys=("symbol",), order: str = "ts") -> DataFrame:
    """Blocks of 256 rows plus one leading row, so lag(1) works in a block."""
    out = blocks(df, lookback=1, size=EMA_ROWS, keys=keys, order=order)
    return out.withColumn("_p", (F.col("_i") - F.col("_b") * EMA_ROWS + 1).cast("int"))


def _fold(step: float):
    return lambda acc, x: acc * F.lit(step) + x


def linear_scan(df: DataFrame, specs: dict[str, tuple[Column, float]], keys=("symbol",)) -> DataFrame:
    """Solve s_t = beta * s_(t-1) + u_t from zero for every ``name: (u, beta)``.

    Inside a block a running sum gives the local part; the state entering a
    block is folded from the totals of all preceding blocks whose weight is a
    positive double, whatever their size. With ``beta`` 0 the state is the input.
    """
    keys = list(keys)
    run = window(keys).rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("_p").cast("double")
    totals, carries, local, final = [], {}, {}, {}
    chain = Window.partitionBy(*keys).orderBy("_b")
    for name, (u, beta) in specs.items():
        if beta == 0.0:
            final[name] = u
            continue
        step = beta ** EMA_ROWS
        depth = 1 + (math.ceil(745.0 / -math.log(step)) if step > 0 else 0)  # exp(-745) is the least positive double
        totals.append(F.sum(u * F.pow(F.lit(beta), F.lit(float(EMA_ROWS - 1)) - p)).alias(f"_t_{name}"))
        carries[f"_c_{name}"] = F.aggregate(
            F.collect_list(f"_t_{name}").over(chain.rowsBetween(-(depth - 1), 0)),
            F.lit(0.0), _fold(step))
        local[f"_l_{name}"] = F.pow(F.lit(beta), p) * F.sum(u * F.pow(F.lit(beta), -p)).over(run)
        final[name] = F.col(f"_l_{name}") + F.pow(F.lit(beta), p + 1) * F.coalesce(F.col(f"_c_{name}"), F.lit(0.0))
    if not totals:
        return df.select(*[c for c in df.columns if c not in final], *[x.alias(n) for n, x in final.items()])
    ends = (
        df.where(F.col("_p") <= EMA_ROWS - 1)
        .groupBy(*keys, "_b").agg(F.max("_p").alias("_mp"), *totals)
        .where(F.col("_mp") == EMA_ROWS - 1)
        .select(*keys, (F.col("_b") + 1).alias("_b"), *[c.alias(n) for n, c in carries.items()])
    )
    out = df.withColumns(local).join(ends, [*keys, "_b"], "left")
    keep = [c for c in df.columns if c not in final]
    return out.select(*keep, *[x.alias(n) for n, x in final.items()])


def ema_input(x: Column, span: float, start: int = 0) -> tuple[Column, float]:
    """(u, beta) of the recursive EMA seeded with the value at row ``start``."""
    if span < 1:
        raise ValueError("span must be 1 or more")
    alpha = 2.0 / (span + 1.0)
    i = F.col("_i")
    u = F.when(i == start, x).when(i > start, F.lit(alpha) * x).otherwise(F.lit(0.0))
    return u, 1.0 - alpha


def emas(df: DataFrame, specs: dict[str, tuple[Column, int]], warmup: bool = False,
         keys=("symbol",)) -> DataFrame:
    """EMA columns on a frame from ``ema_blocks``; ``warmup`` hides short history."""
    out = linear_scan(df, {n: ema_input(x, span) for n, (x, span) in specs.items()}, keys)
    # the seed is the value itself, free of rounding
    out = out.withColumns({n: F.when(F.col("_i") == 0, x).otherwise(F.col(n)) for n, (x, _) in specs.items()})
    if warmup:
        out = out.withColumns({
            n: F.when(F.col("_i") >= span - 1, F.col(n)) for n, (_, span) in specs.items()})
    return out


def ewm_std_specs(x: Column, span: int, start: int = 0) -> dict[str, tuple[Column, float]]:
    """The four weighted sums behind ``ewm_std``; ``x`` is non-null from row ``start``."""
    beta = 1.0 - 2.0 / (span + 1.0)
    live = F.col("_i") >= start
    zero, one = F.lit(0.0), F.lit(1.0)
    return {
        "_w": (F.when(live, one).otherwise(zero), beta),
        "_v": (F.when(live, one).otherwise(zero), beta * beta),
        "_x": (F.when(live, x).otherwise(zero), beta),
        "_q": (F.when(live, x * x).otherwise(zero), beta),
    }


def ewm_std(start: int = 0) -> Column:
    """Weighted std with finite-sample weights and bias correction."""
    num = F.col("_w") * F.col("_q") - F.col("_x") * F.col("_x")
    den = F.col("_w") * F.col("_w") - F.col("_v")
    var = F.when(F.col("_i") > start, F.try_divide(num, den))
    return F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0))))


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of an aggregate without groups (always one row) to every row of ``df``."""
    return df.join(F.broadcast(one_row), F.lit(True))


def expand(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Every row of ``df`` once per row of a small dimension (rules, scenarios, factors)."""
    packed = dim.agg(F.collect_list(F.struct(*dim.columns)).alias("_dim"))
    return attach(df, packed).select(*df.columns, F.inline("_dim"))
