"""Spark helpers shared by the operators: held-out folds, skew-proof joins, distributed ranks, components."""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from barloom.llm.kernels import slices, utf8
from barloom.session import cut, discard

ASCII_SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SMALL = 50_000


def fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod ``modulus`` is ``remainder``; a NULL id counts as empty text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % modulus == remainder


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns that tell rows apart: (NULL flag, id, hash of the text); rows alike in all are repeats of one row."""
    return [doc_id.isNull().alias("_nil"), F.coalesce(doc_id.cast("bigint"), F.lit(0)).alias("_id"),
            F.xxhash64(text).alias("_hash")]


KEY = ["_nil", "_id", "_hash"]


def own_columns(docs: DataFrame) -> Column:
    """All columns of a row as one struct ``_own``, out of reach of result columns of the same names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")


def annotate(docs: DataFrame, kernel: Callable[[pa.RecordBatch], tuple[list[pa.Array], pa.Array | None]],
             fields: T.StructType, drop: tuple[str, ...] = (), by: str = "text", limit: int = 4 << 20) -> DataFrame:
    """Add columns computed by ``kernel(batch) -> (arrays, keep mask or None)`` in Arrow batches.

    The kernel sees rows with at most ``limit`` bytes in column ``by`` at a time
    (a longer text stands alone). Input columns that carry the name of a new
    one are replaced; ``drop`` names input columns that need not travel back.
    """
    docs = docs.drop(*[f.name for f in fields])
    kept = [f for f in docs.schema if f.name not in drop]
    names, new = [f.name for f in kept], [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(utf8(batch.column(by))[1], limit):
                b = batch.slice(i, j - i)
                arrays, mask = kernel(b)
                out = pa.RecordBatch.from_arrays([b.column(n) for n in names] + arrays, names=names + new)
                yield out if mask is None else out.filter(mask)

    return docs.mapInArrow(run, T.StructType(kept + list(fields.fields)))


def attach(rows: DataFrame, groups: DataFrame, key: str, n: str = "n", share: int = 1000, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``groups`` (one row per non-NULL key, ``n`` = its number of rows), safe for hot keys.

    Keys with more than 1/``share`` of all rows are fewer than ``share``, so
    that side is broadcast with this bound; all other keys are small and join
    by a shuffle. ``rows`` is read twice and should be a stored table. Up to
    SMALL groups are broadcast whole.
    """
    total, count = groups.agg(F.sum(n), F.count("*")).first()
    total = total or 0
    if count <= SMALL:
        return rows.join(F.broadcast(groups), key, how)
    heavy = F.col(n) * share > total
    hot = F.broadcast(groups.filter(heavy))
    return (rows.join(hot, key)
            .unionByName(rows.join(F.broadcast(groups.filter(heavy).select(key)), key, "left_anti")
                         .join(groups.filter(~heavy), key, how)))


def ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, stored, with ``_at``: a number that grows in that order.

    ``order`` must be free of large ties. ``_at`` holds the partition above bit 33 and the row in it below.
    """
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def _with_shift(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Add ``_s0``, ``_s1``, ...: each sum over all partitions before the row's own (one row a partition)."""
    part = rows.withColumn("_p", F.shiftright("_at", 33))
    totals = part.groupBy("_p").agg(*[F.sum(F.expr(x)).alias(f"_t{i}") for i, x in enumerate(sums.values())])
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select("_p", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}")
                                  for i in range(len(sums))])
    return part.join(F.broadcast(shift), "_p")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Global row numbers from 0 of an ``ordered`` table, without another shuffle of its rows."""
    return (_with_shift(rows, {name: "1"}).withColumn(name, F.col("_s0") + F.col("_at").bitwiseAND((1 << 33) - 1))
            .drop("_p", "_s0"))


def sketch(minima: np.ndarray) -> np.ndarray:
    """Two bits of every MinHash value, as (rows, k) longs: values that differ agree in half of their bits."""
    bits = (minima[:, :, None] >> np.arange(2, dtype=np.uint32) & 1).astype(np.uint8).reshape(len(minima), -1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64).reshape(len(minima), -1)


def far_bits(values: int, least: float, deviations: float = 2.6) -> int:
    """Differing sketch bits of ``values`` MinHash values that a pair of similarity ``least`` exceeds in one case of 200."""
    other = values * (1 - least)
    return int(other + deviations * math.sqrt(other / 2 + other * least))


def running(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Add to (slim) rows of an ``ordered`` table the sum of each SQL expression over all rows before."""
    own = W.partitionBy("_p").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    local = _with_shift(rows, sums)
    return local.select(*rows.columns, *[(F.col(f"_s{i}") + F.coalesce(F.sum(F.expr(x)).over(own), F.lit(0))).alias(name)
                                         for i, (name, x) in enumerate(sums.items())])


def components(links: DataFrame) -> DataFrame:
    """Distributed union-find: (node, root) of every node in ``links`` (a, b), root = the smallest node it reaches.

    Alternates large-star and small-star steps until nothing changes; every
    step writes its edges to the shared folder, so a lost executor never
    restarts the loop and the plan stays short.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return cut(df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = tidy(links)
    seen = mark(edges)
    while seen[0]:
        both = cut(edges.union(edges.select("b", "a")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        large = (attach(both, least, "a").filter("b > a")
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        old, large = edges, tidy(large)
        discard(both)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = (attach(large, least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))))
        edges = tidy(small)
        discard(old, large)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
