"""Shards along a Hilbert curve over several metadata columns.

Each dimension is quantised into cells of equal row counts (distributed ranks
over its distinct values, equal values stay together), the cells give a curve
index, rows are sorted by it, and the sorted run is cut into shards. Neighbours
on the curve are close in every dimension, so each file covers a narrow range
of all of them and min/max statistics prune on any.

Laws: ``rows`` cuts at equal row counts (at most one apart), ``bytes`` at equal
sums of sizes. Ties on the curve are ordered by a hash of the text, so equal
texts with equal metadata are neighbours, then by doc_id. NULL metadata comes
first in its dimension, a NULL text has no bytes and checksum 0, repeated rows
take slots of their own. Everything is a DataFrame operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import numbered, ordered, running, text_bytes
from barloom.session import cut


def cell(rows: DataFrame, column: str, bits: int, total: int) -> Column:
    """The equal-count cell, 0 to 2^bits - 1, of ``column``; NULL is in cell 0.

    Distinct values are ranked by a distributed running count; only the least
    value of each cell, at most 2^bits of them, comes to the driver.
    """
    distinct = rows.groupBy(column).agg(F.count("*").alias("n"))
    before = running(ordered(distinct, [F.col(column).asc_nulls_first()]), {"_before": "n"})
    number = F.floor(F.col("_before") * (1 << bits) / total).cast("int")
    found = before.groupBy(number.alias("c")).agg(F.min(column).alias("low")).filter("low IS NOT NULL").orderBy("c").collect()
    if not found:
        return F.lit(0)
    kind = distinct.schema[column].dataType
    lows = F.array(*[F.lit(r.low).cast(kind) for r in found])
    return F.coalesce(F.get(F.array(*[F.lit(r.c) for r in found]), F.size(F.filter(lows, lambda low: low <= F.col(column))) - 1), F.lit(0))


def hilbert(axes: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve (Skilling's transpose form), as nested folds over an array of axes."""
    n = len(axes)
    dims = F.array(*[F.lit(i) for i in range(n)])
    start = F.array(*[a.cast("bigint") for a in axes])
    zero = F.lit(0).cast("bigint")

    def bit_values(lowest: int) -> Column:
        return F.array(*[F.lit(1 << b).cast("bigint") for b in range(bits - 1, lowest - 1, -1)])

    def let(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    def undo(x: Column, i: Column, q: Column) -> Column:
        """Reflect or swap axis ``i`` with the first below bit ``q``."""
        low, own = q - 1, F.get(x, i)
        t = x[0].bitwiseXOR(own).bitwiseAND(low)
        reflect = own.bitwiseAND(q) != 0
        return F.transform(x, lambda v, j: F.when(reflect & (j == 0), v.bitwiseXOR(low))
                           .when(~reflect & ((j == 0) | (j == i)) & (i != 0), v.bitwiseXOR(t)).otherwise(v))

    def gray(x: Column) -> Column:
        return F.aggregate(dims, F.slice(x, 1, 0), lambda acc, i: F.concat(acc, F.array(
            F.get(x, i).bitwiseXOR(F.coalesce(F.get(acc, i - 1), zero)))))

    def index(g: Column) -> Column:
        t = F.aggregate(bit_values(1), zero,
                        lambda acc, q: F.when(g[n - 1].bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
        return let(t, lambda u: F.aggregate(bit_values(0), zero, lambda h, q: F.aggregate(
            g, h, lambda k, v: k * 2 + F.when(v.bitwiseXOR(u).bitwiseAND(q) != 0, 1).otherwise(0))))

    turned = F.aggregate(bit_values(1), start, lambda acc, q: F.aggregate(dims, acc, lambda y, i: undo(y, i, q)))
    return let(let(turned, gray), index)


MADE = ("size", "text_crc32", "law", "shard", "slot", "curve")


def shard(docs: DataFrame, shards: int, dims: tuple[str, ...] = ("lang", "source", "doc_id"), law: str = "rows",
          bits: int = 8, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row with ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``law``, ``shard``, ``slot`` and ``curve``.

    ``size`` may be one of ``dims``. Rows are shuffled once, in curve order.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    docs = docs.drop(*MADE)
    rows = docs.withColumns({"size": text_bytes(F.col(text)) + 8, "text_crc32": F.coalesce(F.crc32(text), F.lit(0)),
                             "_hash": F.xxhash64(text)})
    rows = rows if keep_text else cut(rows.drop(text))
    names = [c for c in rows.columns if c != "_hash"]
    total, weight = rows.agg(F.count("*"), F.sum("size")).first()
    axes = [cell(rows, d, bits, max(total, 1)) for d in dims]
    order = [F.col(c) for c in ("curve", "_hash", doc_id, "text_crc32")]
    run = ordered(rows.withColumn("curve", hilbert(axes, bits)), order)
    run = numbered(run, "_row")
    if law == "rows":  # integer arithmetic: counts at most one apart at any size
        run = run.withColumn("shard", F.expr(f"cast(_row * {shards} div {max(total, 1)} as int)"))
    else:
        place = F.expr(f"cast(cast(_before + size div 2 as decimal(38,0)) * {shards} div {max(weight or 1, 1)} as int)")
        cuts = running(run.select("_at", "size"), {"_before": "size"}).groupBy(place.alias("s")).agg(F.min("_at").alias("a"))
        first = F.array(*[F.struct(F.lit(r.a).alias("a"), F.lit(r.s).alias("s")) for r in cuts.orderBy("s").collect()]
                        or [F.struct(F.lit(0).alias("a"), F.lit(0).alias("s"))])  # one entry a shard
        run = run.withColumn("shard", F.array_max(F.filter(first, lambda x: x.a <= F.col("_at")))["s"])
    least = run.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row a shard
    return (run.join(F.broadcast(least), "shard")
            .select(*names, F.lit(law).alias("law"), "shard", (F.col("_row") - F.col("_first")).alias("slot"), "curve"))


def write_shards(placed: DataFrame, path: str) -> None:
    """Write placed documents as one folder per shard, in slot order."""
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def op10_sharding(docs: DataFrame) -> DataFrame:
    """Contract columns of every document, 24 shards of equal row counts."""
    out = shard(docs.select("doc_id", "text", "lang", "source"), 24, keep_text=False)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
