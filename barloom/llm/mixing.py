"""Mix sources to target weights by cutting hash-ordered documents at each source's budget.

Every row gets a random key from a hash of its id. Within a source, rows are
ordered by key; their sizes are summed up to each row by a distributed prefix
sum: the key range of a source is split into about sqrt(rows) equal ranges,
range totals are summed per source, and each range sums its own rows. A source
whose target is e whole epochs and a rest gives every row e times, and the rows
before the cut once more; the row at the cut gives exactly the words missing.

NULL texts have size 0, a NULL source is a source of its own and comes last, a
source without words has target 0. Repeated rows count each time. Equal keys
are ordered by id, then size. Input columns named like a result column are
replaced. Everything is a DataFrame operation; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from barloom.llm.common import WORD, numbered, ordered
from barloom.session import cut

MOST = 3  # epochs at most


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(doc_id: Column, seed: str) -> Column:
    """Uniform 48-bit integer from a hash of the id, the same in every engine."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


KEYS = 1 << 48


def cycle_weights(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """Sources by code point, NULL last, with the weights repeating."""
    order = [F.col("_src").isNull(), F.col("_src")]
    place = (F.col("_i") % len(weights)).cast("int")
    return numbered(ordered(sources, order), "_i").withColumn(
        "weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place)).drop("_i", "_at")


def targets(sources: DataFrame) -> DataFrame:
    """Add ``target``: shares of all words by ``weight``, none above MOST times its source.

    What a full source cannot take is shared out again by weight until no
    source is above its limit; each round is one aggregate over the sources
    that returns three numbers.
    """
    limit = F.col("source_size") * MOST
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        capped = F.lit(full >= 0) & (limit <= F.col("weight") * level)
        taken, left, n = sources.agg(
            F.sum(F.when(capped, limit).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))),
            F.sum(capped.cast("int"))).first()
        if n == full or not left:
            break
        level, full = (total - taken) / left, n
    return sources.withColumn("target", F.least(limit.cast("double"), F.col("weight") * level))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
        weights: tuple[float, ...] = (1, 2, 3), size: Column | None = None) -> DataFrame:
    """One slim row per document: id, source, ``size``, ``source_size``, ``target``, ``epochs``, ``taken`` and ``_key``."""
    rows = cut(docs.select(
        F.col(doc_id).alias("_doc"), F.col(source).alias("_src"), (words(F.col(text)) if size is None else size).alias("size"),
        random_key(F.col(doc_id), seed).alias("_key")))
    sources = cut(rows.groupBy("_src").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    plan = cut(targets(cycle_weights(sources, weights)).select(
        "_src", "source_size", "target",
        F.ceil(F.sqrt("rows")).cast("bigint").alias("ranges"),
        F.expr("if(source_size > 0, cast(round(target) as bigint) div source_size, 0)").alias("epochs"))
        .withColumn("rest", F.round("target").cast("bigint") - F.col("epochs") * F.col("source_size")))
    keyed = _beside(rows, plan).withColumn("_range", F.floor(F.col("_key") / (F.lit(float(KEYS)) / F.col("ranges"))))
    per_source = W.partitionBy("_src").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = (keyed.groupBy("_src", "_range").agg(F.sum("size").alias("_sum"))
              .withColumn("_base", F.coalesce(F.sum("_sum").over(per_source), F.lit(0))).drop("_sum"))
    own = W.partitionBy("_src", "_range").orderBy("_key", "_doc", "size").rowsBetween(W.unboundedPreceding, -1)
    local = keyed.withColumn("_own", F.coalesce(F.sum("size").over(own), F.lit(0))).alias("l")
    r = totals.alias("r")
    joined = local.join(r, F.col("l._src").eqNullSafe(F.col("r._src")) & (F.col("l._range") == F.col("r._range")))
    extra = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("_own") - F.col("_base")))
    return joined.select(
        F.col("_doc").alias(doc_id), F.col("l._src").alias(source), "size", "source_size", "target", "epochs",
        (F.col("epochs") * F.col("size") + extra).alias("taken"), "_key")


def _beside(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the numbers of their source; Spark broadcasts the plan only if its stored size is small."""
    left, right = rows.alias("l"), plan.alias("r")
    return left.join(right, F.col("l._src").eqNullSafe(F.col("r._src"))).select(
        "l.*", *[F.col(f"r.{c}") for c in plan.columns if c != "_src"])


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    seed: str = "mix", weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: documents of every epoch, whole, as repeated rows with all their columns.

    The row at a cut is taken once more if at least half of it fits. Rows
    before the cut are found by comparing keys with the cut of their source, so
    texts are not shuffled.
    """
    plan = mix(docs, doc_id, text, source, seed, weights)
    whole = F.col("taken") - F.col("epochs") * F.col("size")
    cuts = (plan.groupBy(F.col(source).alias("_src")).agg(
        F.max("epochs").alias("epochs"),
        F.max(F.when((F.col("size") > 0) & (2 * whole >= F.col("size")), F.struct("_key", doc_id))).alias("_last")))
    cuts = cut(cuts)
    key = F.struct(random_key(F.col(f"l.{doc_id}"), seed).alias("_key"), F.col(f"l.{doc_id}").alias(doc_id))
    copies = F.col("r.epochs") + F.coalesce(key <= F.col("r._last"), F.lit(False)).cast("int")
    return (docs.alias("l").join(cuts.alias("r"), F.col(f"l.{source}").eqNullSafe(F.col("r._src")))
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
            .select(*[F.col(f"l.{c}") for c in docs.columns]))


def op1_mixing(docs: DataFrame) -> DataFrame:
    """Contract columns of every document."""
    out = mix(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), 'null'))[1:12] AS k FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM rows_ GROUP BY source),
lvl AS (
  SELECT 0 AS i, CAST(sum(source_size) AS DOUBLE) / sum(weight) AS lam, 0.0::DOUBLE AS before FROM src
  UNION ALL
  SELECT i + 1, (SELECT (sum(source_size) - COALESCE(sum(3 * source_size) FILTER (3 * source_size <= weight * l.lam), 0))
    / sum(weight) FILTER (3 * source_size > weight * l.lam) FROM src), l.lam
  FROM lvl l WHERE l.lam <> l.before AND i < 1000),
plan AS (
  SELECT source, source_size, least(3.0 * source_size, weight * (SELECT arg_max(lam, i) FROM lvl WHERE lam IS NOT NULL)) AS target FROM src),
cum AS (
  SELECT r.doc_id, r.size, p.source_size, p.target, CAST(round(p.target) AS BIGINT) AS goal,
    COALESCE(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.doc_id, r.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows_ r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CASE WHEN source_size = 0 THEN 0 ELSE
    CAST((goal // source_size) * size + least(size, greatest(0, goal % source_size - before)) AS BIGINT) END AS taken
FROM cum
"""
