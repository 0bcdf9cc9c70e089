"""Bar store: scan, normalise, merge, and the layout they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.schema import as_bars
from barloom.session import cut


def normalise(raw: DataFrame, seq: Column | None = None, keys=("symbol", "ts")) -> DataFrame:
    """One row per (symbol, ts): the one with the highest ``seq`` (ingest order).

    A map-side combined max, so duplicates of a hot symbol or stamp shrink
    before the shuffle.
    """
    keys = list(keys)
    cols = [c for c in raw.columns if c not in keys and c != "_seq"]
    order = F.col("_seq") if seq is None else seq
    return raw.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_s")).select(
        *keys, *[F.col(f"_s.{c}").alias(c) for c in cols])


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 2_000_000) -> None:
    """Store bars by year in files of about ``rows_per_file`` rows, each a range of symbols and, within a large symbol, of time.

    The number of files follows the number of rows: little data makes few files,
    a hot symbol fills many. Year folders prune date slices; as a file covers a
    narrow range of symbols, its statistics prune symbols. Only the years in
    ``bars`` are replaced.
    """
    df = cut(as_bars(bars).withColumn("year", F.year("ts")))
    files = -(-df.count() // rows_per_file) or 1
    order = ("year", "symbol", "ts")
    (df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("year").parquet(path))


def scan_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
              symbols: list[str] | None = None) -> DataFrame:
    """Bars in [start, end] (inclusive dates); year folders and row groups are pruned."""
    df = spark.read.parquet(path)
    if start:
        df = df.where((F.col("year") >= int(start[:4])) & (F.col("ts") >= F.lit(start).cast("date")))
    if end:
        df = df.where((F.col("year") <= int(end[:4])) & (F.col("ts") < F.date_add(F.lit(end).cast("date"), 1)))
    if symbols:
        df = df.where(F.col("symbol").isin(*symbols))
    return df.drop("year")


def merge(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union of stored and fresh bars; a fresh bar replaces a stored one."""
    both = stored.withColumn("_seq", F.lit(0)).unionByName(fresh.withColumn("_seq", F.lit(1)))
    return normalise(both)


def update_store(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Merge fresh bars into the store, rewriting only the years they touch."""
    fresh = cut(as_bars(fresh))
    years = fresh.select(F.year("ts").alias("year")).distinct()
    stored = spark.read.parquet(path).join(F.broadcast(years), "year", "left_semi").drop("year")
    write_bars(cut(merge(stored, fresh)), path)
