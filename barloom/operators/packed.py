"""Series packed into blocks of rows, for work that is a few array operations per block.

``pack`` turns a numbered series into one row per ``size`` bars with its columns
as arrays; a block is the unit that moves, whatever the length of the series.
``each_block`` runs a numpy kernel over the blocks. Results that add up over
blocks (sums per simulation, per parameter) are combined by Spark, so no row is
ever copied per simulation.

An ``Additive`` metric is a function of sums over single returns; it can be
computed from blocks, from draws with repetition and from differences of
running sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from barloom.functions.scalars import MIX_I, MIX_SEED, MIX_SIM, PRIME, TRADING_DAYS

SIZE = 4096
ANNUAL = math.sqrt(TRADING_DAYS)


@dataclass(frozen=True)
class Additive:
    """A metric made of sums over single returns.

    ``parts`` maps an array of returns to the array of each sum, ``exprs`` a
    Column to the Column of each; ``finish`` combines the sums, given as a function
    from name to Column. ``n`` is the number of returns.
    """
    parts: Callable[[np.ndarray], dict[str, np.ndarray]]
    exprs: Callable[[Column], dict[str, Column]]
    names: tuple[str, ...]
    finish: Callable[[Callable[[str], Column]], Column]


def _ratio(c: Callable[[str], Column], n: str, s: str, q: str) -> tuple[Column, Column]:
    mean = F.try_divide(c(s), c(n))
    var = F.when(c(n) > 1, (c(q) - c(s) * c(s) / c(n)) / (c(n) - 1))
    return mean, F.sqrt(F.greatest(var, F.lit(0.0)))


def _sharpe(c: Callable[[str], Column]) -> Column:
    mean, std = _ratio(c, "n", "s", "q")
    return F.coalesce(F.try_divide(mean, std), F.lit(0.0)) * ANNUAL


def _squares(r):
    return {"s": r, "q": r * r}


SHARPE = Additive(_squares, _squares, ("s", "q"), _sharpe)
MEAN = Additive(lambda r: {"s": r}, lambda r: {"s": r}, ("s",), lambda c: F.try_divide(c("s"), c("n")))
VOLATILITY = Additive(_squares, _squares, ("s", "q"), lambda c: _ratio(c, "n", "s", "q")[1] * ANNUAL)
WIN_RATE = Additive(lambda r: {"w": (r > 0).astype(float)}, lambda r: {"w": (r > 0).cast("double")}, ("w",),
                    lambda c: F.try_divide(c("w"), c("n")) * 100)
TOTAL_RETURN = Additive(lambda r: {"g": np.log1p(r)}, lambda r: {"g": F.log1p(r)}, ("g",), lambda c: F.exp(c("g")) - 1)


def pack(df: DataFrame, columns: list[str], keys=("symbol",), size: int = SIZE) -> DataFrame:
    """(keys, b, first, m, columns as arrays): ``m`` rows from row number ``first`` = b * size of every series, in order."""
    keys = list(keys)
    def values(c: str) -> Column:
        return F.transform("_r", lambda x: x[c].cast("double")).alias(c)

    row = F.struct("_i", *columns)
    g = df.groupBy(*keys, F.floor(F.col("_i") / size).alias("b")).agg(F.sort_array(F.collect_list(row)).alias("_r"))
    return g.select(*keys, "b", (F.col("b") * size).alias("first"), F.size("_r").alias("m"), *map(values, columns))


def array_of(col: pa.ListArray, i: int) -> np.ndarray:
    """One list of an Arrow column as doubles, NULL as NaN."""
    return col[i].values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def each_block(blocks: DataFrame, kernel: Callable[[dict], Iterator[dict]], fields: str, keep: tuple[str, ...]) -> DataFrame:
    """Rows ``keep`` + ``fields`` from ``kernel(row)``, which sees a block as a dict (lists as arrays of doubles)."""
    kept = [blocks.schema[k] for k in keep]
    new = T.StructType.fromDDL(fields)
    schema = T.StructType([*kept, *new.fields])
    names = [f.name for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = {n for n, t in zip(b.schema.names, b.schema.types) if pa.types.is_list(t)}
            source, columns = [], {n: [] for n in names}
            for i in range(b.num_rows):
                row = {n: array_of(b.column(n), i) if n in lists else b.column(n)[i].as_py() for n in b.schema.names}
                for out in kernel(row):
                    source.append(i)
                    for n in names:
                        columns[n].append(out[n])
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(k).take(at) for k in keep] + [
                pa.array(columns[f.name], arrow_type(f.dataType)) for f in new.fields], names=[*keep, *names])

    return blocks.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[kind.simpleString()]


def uniforms(seed: int, sims: np.ndarray, i: np.ndarray) -> np.ndarray:
    """``scalars.uniform`` for every (sim, i), as a matrix; the same integers."""
    x = (i[None, :].astype(np.int64) * MIX_I + sims[:, None].astype(np.int64) * MIX_SIM + (seed * MIX_SEED + 1)) % PRIME
    for step in (12345, 67891):
        q = x * x % PRIME
        x = (q * q % PRIME * x % PRIME + step) % PRIME
    return x / float(PRIME)


def gaussians(seed: int, sims: np.ndarray, i: np.ndarray) -> np.ndarray:
    """``scalars.gaussian`` as a matrix."""
    return np.sqrt(-2.0 * np.log(1.0 - uniforms(seed, sims, i))) * np.cos(6.283185307179586 * uniforms(seed + 7919, sims, i))


def sums(metric: Additive, r: np.ndarray, n: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Per row of the matrix ``r``: the metric's sums over its columns and their number."""
    out = {k: v.sum(axis=-1) for k, v in metric.parts(r).items()}
    return {"n": np.full(len(r), float(r.shape[-1])) if n is None else n, **out}


def total(parts: DataFrame, metric: Additive, by: list[str], name: str = "metric") -> DataFrame:
    """Add up partial sums given as arrays over ``no`` (one entry per simulation) and finish the metric.

    ``parts`` has array columns n and the metric's names, all of one length.
    """
    names = ["n", *metric.names]
    flat = parts.select(*by, F.posexplode(F.arrays_zip(*names)).alias("sim", "_z"))
    g = flat.groupBy(*by, "sim").agg(*[F.sum(f"_z.{k}").alias(f"_{k}") for k in names]).where("_n > 0")
    return g.select(*by, "sim", metric.finish(lambda k: F.col(f"_{k}")).alias(name))


def sum_fields(metric: Additive) -> str:
    return ", ".join(f"{k} array<double>" for k in ("n", *metric.names))


# ------------------------------------------------------------- vector recurrences

def ema_run(x: np.ndarray, alpha: np.ndarray, start: np.ndarray) -> np.ndarray:
    """States of s = (1 - alpha) s + alpha x for every alpha (columns) before each row; the last row is the end state."""
    out = np.empty((len(x) + 1, len(alpha)))
    out[0] = start
    beta = 1.0 - alpha
    for t, v in enumerate(x):
        out[t + 1] = beta * out[t] + alpha * v
    return out


def ema_carry(blocks: DataFrame, column: str, spans: list[float], keys=("symbol",), size: int = SIZE) -> DataFrame:
    """``blocks`` with ``carry``: the EMAs of all spans at the row before the block (seeded with the first value).

    One pass gives every block's own contribution as a vector; the state before
    a block is folded from as many earlier blocks as still weigh more than the
    smallest double.
    """
    keys = list(keys)
    alpha = 2.0 / (np.array(spans, float) + 1.0)

    def own(row: dict) -> Iterator[dict]:
        x = row[column]
        start = np.full(len(alpha), x[0]) if row["b"] == 0 else np.zeros(len(alpha))
        yield {"_end": ema_run(x[1:] if row["b"] == 0 else x, alpha, start)[-1].tolist()}

    ends = each_block(blocks.select(*keys, "b", column), own, "_end array<double>", (*keys, "b"))
    steps = [float((1.0 - a) ** size) for a in alpha]
    slowest = max(steps)
    depth = 1 + (math.ceil(745.0 / -math.log(slowest)) if slowest > 0 else 0)
    before = Window.partitionBy(*keys).orderBy("b").rowsBetween(-depth, -1)
    step, zero = F.array(*map(F.lit, steps)), F.array(*[F.lit(0.0)] * len(steps))
    fold = F.aggregate(F.collect_list("_end").over(before), zero, lambda acc, e: F.zip_with(
        F.zip_with(acc, step, lambda a, s: a * s), e, lambda a, x: a + x))
    return blocks.join(ends.select(*keys, "b", fold.alias("carry")), [*keys, "b"])


def each_run(df: DataFrame, by: list[str], kernel: Callable[[dict, pa.Table], Iterator[dict]], fields: str, order: list[str] | None = None) -> DataFrame:
    """Rows ``by`` + ``fields`` from ``kernel(key, rows)`` for every group; groups stream through sorted partitions.

    A group is held whole, so ``by`` must bound its size.
    """
    new = T.StructType.fromDDL(fields)
    schema = T.StructType([*[df.schema[k] for k in by], *new.fields])
    names = [f.name for f in new.fields]

    def rows(key: tuple, parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        out = list(kernel(dict(zip(by, key, strict=True)), pa.Table.from_batches(parts).combine_chunks()))
        values = [[k] * len(out) for k in key] + [[o[n] for o in out] for n in names]
        kinds = [parts[0].schema.field(k).type for k in by] + [arrow_type(f.dataType) for f in new.fields]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=[*by, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for b in batches:
            keys = list(zip(*[b.column(k).to_pylist() for k in by], strict=True))
            first = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[first]:
                    continue
                if keys[first] != key and parts:
                    yield rows(key, parts)
                    parts = []
                key = keys[first]
                parts.append(b.slice(first, i - first))
                first = i
        if parts:
            yield rows(key, parts)

    return df.repartition(*by).sortWithinPartitions(*by, *(order or [])).mapInArrow(run, schema)
