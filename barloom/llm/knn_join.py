"""Exact top-k search by inner product: a Voronoi join of queries and data.

Queries and data are grouped by the nearest of a few pivots. Summaries per data
ring (a range of distances to a pivot: row count, largest distance, least and
largest norm) and per query group (radius, norms) bound every score between
the two: by the triangle inequality on distances, and by expanding the inner
product around both pivots. The rings whose lower bounds add up to k + 1 rows
(one may be the query itself) give a group's threshold; a ring whose upper bound
stays below it cannot hold a result and is not sent. The remaining data rows
are replicated to the query groups that need them, in units of about ``unit``
rows, so neither a hot cell nor a hot query group is one task: a unit holds one
block of queries, streams its data and keeps the best k of each query. A rank
per query over the units' results ends the search.

Components become floor(1024 * x), computed as double. Every sum is exact: in
double precision as long as norms allow it, otherwise in integers of any size,
of which scores beyond a long are returned as the nearest long. Vectors that
are NULL or hold NULL or non-finite components take no part. Shorter vectors
count as filled up with zeros. A row is a query if ``is_query`` holds for its
id; rows with a NULL id are never queries and lose ties. Rows that repeat an
id are rows of their own: a query skips only itself. An empty table, or one
without queries, gives no rows. Columns other than id and vector are ignored.

Memory of a task: one block of queries (at most ``block`` vectors) and one
Arrow batch of data. On the driver: the pivots and one row of bounds a pair of
pivots and ring, of which the ``most_pivots`` and the doubling rings bound the
number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from barloom.session import cut

K = 10
SCALE = 1024
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
TILE = 1 << 20
RINGS = 8  # rings per doubling of the distance


def unpack(col: pa.Array, kind: str) -> np.ndarray:
    """Binary vectors of one column as a matrix of doubles, filled up with zeros."""
    raw = [np.frombuffer(v, kind) for v in col.to_pylist()]
    width = max(map(len, raw), default=0)
    if all(len(v) == width for v in raw):
        return np.array(raw, np.float64).reshape(len(raw), width)
    out = np.zeros((len(raw), width))
    for row, v in zip(out, raw, strict=True):
        row[:len(v)] = v
    return out


def widen(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with the larger number of columns."""
    w = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, w - m.shape[1]))) if m.shape[1] < w else m for m in (a, b))


def norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as longs."""
    most = norms(q).max(initial=0) * norms(x).max(initial=0)
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in q.tolist()], [[int(v) for v in row] for row in x.tolist()]
    return np.array([[max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(u, v, strict=True)))) for v in whole[1]]
                     for u in whole[0]], np.int64).reshape(len(q), len(x))


def quantised(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, str]:
    """(id, v, norm, _row) of all valid vectors, v as packed floats, and the kind of float."""
    single = vectors.schema[embedding].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"  # floor(1024 x) of a float is a float again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vs, ns = [], [], []
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                if v is None or None in v:
                    continue
                x = np.array(v, np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(SCALE * x)
                ids.append(i)
                vs.append(x.astype(kind).tobytes())
                ns.append(float(np.sqrt(x @ x)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.binary()), pa.array(ns, pa.float64())],
                                             names=["id", "v", "norm"])

    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("v"))
    out = cut(rows.mapInArrow(run, "id bigint, v binary, norm double"))
    return out.withColumn("_row", F.monotonically_increasing_id()), kind


def choose_pivots(rows: DataFrame, n: int, kind: str) -> np.ndarray:
    """Up to ``n`` different vectors, those of the least hashes."""
    found = rows.select("v", F.xxhash64("v").alias("o")).distinct().orderBy("o", "v").limit(n)
    return unpack(pa.array([bytes(r.v) for r in found.collect()], pa.binary()), kind)


def assign(rows: DataFrame, pivots: np.ndarray, kind: str) -> DataFrame:
    """``rows`` with the nearest pivot ``cell``, the distance ``d`` to it and its ``ring``."""
    squares = np.einsum("ij,ij->i", pivots, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, p = widen(unpack(b.column("v"), kind), pivots)
            cells, ds = np.zeros(len(x), np.int64), np.zeros(len(x))
            step = max(1, TILE // len(p))
            for i in range(0, len(x), step):
                part = x[i:i + step]
                cells[i:i + step] = (squares - 2 * (part @ p.T)).argmin(axis=1)
                ds[i:i + step] = norms(part - p[cells[i:i + step]])
            ring = np.floor(RINGS * np.log2(1 + ds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells), pa.array(ds), pa.array(ring)], names=[*b.schema.names, "cell", "d", "ring"])

    return cut(rows.mapInArrow(run, "id bigint, v binary, norm double, _row bigint, cell bigint, d double, ring bigint"))


def bounds(groups: pd.DataFrame, rings: pd.DataFrame, pivots: np.ndarray, k: int) -> pd.DataFrame:
    """(g, cell, least): which data each query group needs, rows at least ``least`` away from the pivot of ``cell``.

    ``groups`` has cell, u (radius), low, high (norms); ``rings`` has cell,
    ring, n, near, far (distances), low, high (norms).
    """
    length = norms(pivots)
    out = []
    j = rings.cell.to_numpy()
    for g in groups.itertuples():
        dot, apart = pivots[j] @ pivots[g.cell], norms(pivots[j] - pivots[g.cell])
        far = rings.far.to_numpy()
        slack = g.u * length[j] + length[g.cell] * far + g.u * far
        nearest, farthest = np.maximum(0, apart - g.u - far), apart + g.u + far
        squares_high, squares_low = g.high ** 2 + rings.high.to_numpy() ** 2, g.low ** 2 + rings.low.to_numpy() ** 2
        upper = np.fmin(np.fmin(dot + slack, (squares_high - nearest ** 2) / 2), g.high * rings.high.to_numpy())
        lower = np.fmax(np.fmax(dot - slack, (squares_low - farthest ** 2) / 2), -g.high * rings.high.to_numpy())
        room = 1 + 1e-9 * (g.high + length[g.cell]) * (rings.high.to_numpy() + length[j] + far)  # rounding of the bounds
        upper, lower = upper + room, lower - room
        order = np.argsort(-lower, kind="stable")
        reach = np.searchsorted(np.cumsum(rings.n.to_numpy()[order]), k + 1)
        threshold = lower[order[reach]] if reach < len(order) else -np.inf
        wanted = rings[~(upper < threshold)]
        least = wanted.groupby("cell").near.min()  # rings nearer than the nearest wanted one are left out
        out.append(pd.DataFrame({"g": g.cell, "cell": least.index.to_numpy(), "least": least.to_numpy()}))
    return pd.concat(out) if out else pd.DataFrame({"g": [], "cell": [], "least": []})


class Best:
    """The ``k`` best rows of every query of one block, over any number of batches."""

    def __init__(self, ids: list, rows: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.rows, self.q, self.k = ids, rows, q, k
        self.floor = np.full(len(q), -LONG - 1)  # the k-th best score so far
        self.found = pd.DataFrame({c: np.empty(0, np.int64) for c in ("at", "score", "none", "vec", "row")})

    def add(self, none: np.ndarray, vec: np.ndarray, row: np.ndarray, x: np.ndarray) -> None:
        q, x = widen(self.q, x)
        step = max(1, TILE // max(1, len(x)))
        for i in range(0, len(q), step):
            score = products(q[i:i + step], x)
            floor, n = self.floor[i:i + step, None], len(x)
            if n > self.k and np.count_nonzero(score >= floor) > 4 * self.k * len(score):
                # k + 1 of this batch, as one of them may be the query itself
                floor = np.maximum(floor, np.partition(score, n - self.k - 1, axis=1)[:, n - self.k - 1, None])
            at, j = np.nonzero((score >= floor) & (row != self.rows[i:i + step, None]))
            self._keep(pd.DataFrame({"at": at + i, "score": score[at, j], "none": none[j], "vec": vec[j], "row": row[j]}))

    def _keep(self, more: pd.DataFrame) -> None:
        hit = self.found["at"].isin(more["at"].unique())
        both = pd.concat([self.found[hit], more])
        both = both.iloc[np.lexsort((both["row"], both["vec"], both["none"], ~both["score"].to_numpy(), both["at"]))]
        both = both[both.groupby("at").cumcount() < self.k]
        self.found = pd.concat([self.found[~hit], both])
        last = both.groupby("at").score.agg(["size", "min"])
        full = last[last["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()

    def result(self) -> pa.RecordBatch:
        f = self.found
        at = f["at"].to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array(self.rows[at]), pa.array([self.ids[i] for i in at], pa.int64()), pa.array(f["score"].to_numpy()),
             pa.array(f["vec"].to_numpy(), mask=f["none"].to_numpy() > 0), pa.array(f["row"].to_numpy())],
            names=["query", "query_id", "score", "vec_id", "row"])


FOUND = "query bigint, query_id bigint, score bigint, vec_id bigint, row bigint"


def solve(units: DataFrame, k: int, kind: str) -> DataFrame:
    """Partial results of all units; rows come sorted by unit, queries before data."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, best, head = None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("g", "qb", "db", "data")])
            cuts = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part, own = b.slice(i, j - i), tuple(keys[:3, i])
                if own != unit:
                    if best is not None:
                        yield best.result()
                    unit, best, head = own, None, []
                if not keys[3, i]:
                    head.append(part)
                    continue
                if best is None:
                    if not head:
                        continue
                    t = pa.Table.from_batches(head)
                    best = Best(t.column("id").to_pylist(), t.column("_row").to_numpy(), unpack(t.column("v").combine_chunks(), kind), k)
                ids = part.column("id")
                best.add(ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(),
                         part.column("_row").to_numpy(), unpack(part.column("v"), kind))
        if best is not None:
            yield best.result()

    keys = ["g", "qb", "db"]
    return units.repartition(*keys).sortWithinPartitions(*keys, "data").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding",
          block: int = 8192, unit: int = 1 << 14, least_pivots: int = 8, most_pivots: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of every query over all other rows, ties to the smaller id.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    rows, kind = quantised(vectors, vec_id, embedding)
    asks = is_query & F.col("id").isNotNull()
    total, queries = rows.agg(F.count("*"), F.count_if(asks)).first()
    pivots = choose_pivots(rows, min(most_pivots, max(least_pivots, -(-queries // block))), kind)
    if not queries:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    placed = assign(rows, pivots, kind)
    rings = placed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("d").alias("near"), F.max("d").alias("far"),
                                               F.min("norm").alias("low"), F.max("norm").alias("high")).toPandas()
    groups = placed.filter(asks).groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("u"), F.min("norm").alias("low"),
                                                     F.max("norm").alias("high")).toPandas()
    need = bounds(groups, rings, pivots, k).merge(pd.DataFrame({"g": groups.cell, "blocks": -(-groups.n // block)}), on="g")
    need = F.broadcast(spark.createDataFrame(need, "g bigint, cell bigint, least double, blocks bigint"))  # at most most_pivots squared rows
    parts = -(-total // unit)
    spread = F.pmod(F.xxhash64("_row"), F.lit(parts))
    blocks = F.broadcast(spark.createDataFrame([(int(c), -(-int(n) // block)) for c, n in zip(groups.cell, groups.n)], "cell bigint, blocks bigint"))
    asked = (placed.filter(asks).join(blocks, "cell")
             .select(F.col("cell").alias("g"), F.pmod(F.xxhash64("_row"), F.col("blocks")).alias("qb"),
                     F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("db"), F.lit(0).alias("data"), "id", "v", "_row"))
    sent = (placed.join(need, (placed.cell == need.cell) & (placed.d >= need.least))
            .select("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("qb"), spread.alias("db"),
                    F.lit(1).alias("data"), "id", "v", "_row"))
    partial = solve(asked.unionByName(sent), k, kind)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return (partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op13_top_k(vectors: DataFrame) -> DataFrame:
    """Every vector whose vec_id is divisible by 100 against all others."""
    return top_k(vectors, F.col("id") % 100 == 0)


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
    FROM e q JOIN e x ON q.vec_id % 100 = 0 AND q.r <> x.r),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 10
"""
