"""Streaming: ticks to watermarked bars to alerts of the screener's signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from barloom.operators.signals import CARRIED, DEFAULT, TripleEma, complete, decision, temacd_step, trend_label, trigger_array
from barloom.session import cut
from barloom.sources.bars import normalise


def read_ticks(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Stream of new parquet files in a folder; zone-free stamps become timestamps."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tick_bars(ticks: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Closed bars of ticks(symbol, ts, price, seq): a bar appears once the watermark passes its end.

    Later ticks are dropped. All aggregates combine before the shuffle and the
    state per open bar is one row, whatever the tick rate of a symbol.
    """
    key = F.struct("ts", "seq")
    g = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width).alias("_w")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return g.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def write_stream(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed bars to parquet, exactly once, and stop when the input is used up."""
    return (bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


STATE = "symbol string, ts timestamp, _i bigint, close double, carried struct<" + ", ".join(f"{n}: double" for n in CARRIED) + ">"


class Versions:
    """Tables of one row per key, one per micro-batch; a batch reads the newest one before it."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keep: int = 2):
        self.spark, self.folder, self.schema, self.keep = spark, folder, schema, keep
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        if not self.fs.exists(self.path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.folder))]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def before(self, batch_id: int) -> DataFrame:
        older = [b for b in self.batches() if b < batch_id and self.fs.exists(self.path(f"{self.folder}/batch={b}/_SUCCESS"))]
        if not older:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch={older[-1]}")

    def write(self, df: DataFrame, batch_id: int) -> None:
        """Replace the version of this batch, then drop all but the newest ``keep``."""
        df.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        for b in [b for b in self.batches() if b <= batch_id][:-self.keep]:
            self.fs.delete(self.path(f"{self.folder}/batch={b}"), True)


def alert_stream(bars: DataFrame, state: str, alerts: str, checkpoint: str, p: TripleEma = DEFAULT, min_bars: int = 250) -> StreamingQuery:
    """Once-per-bar-close alerts of the screener's signal on closed bars.

    What a symbol needs from its past is one row: bar number, last close and the
    six recurrences. Each micro-batch joins its bars with that state, scans the new
    bars alone, writes the alerts and the new states under its own batch folder
    and keeps the state before it, so a replayed batch replaces its output and no
    history is read again. A bar not newer than the symbol's last one is a repeat
    and raises nothing; of repeats inside a batch the one with the highest
    (volume, close) counts. Columns: symbol, ts, close, alert, trend, triggers.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        versions = Versions(batch.sparkSession, state, STATE)
        old = versions.before(batch_id)
        new = normalise(batch.select("symbol", "ts", "close", "volume"), F.struct("volume", "close"))
        last = old.select("symbol", F.col("ts").alias("_last"))
        new = cut(new.join(last, "symbol", "left").where("_last IS NULL OR ts > _last").select("symbol", "ts", "close"))
        conds, changed = temacd_step(new, old, p)
        fired = conds.where((F.col("long") | F.col("short")) & complete(min_bars))
        fired.select("symbol", "ts", "close", decision().alias("alert"),
                     trend_label(F.col("ema1"), F.col("ema2"), F.col("ema3")).alias("trend"), trigger_array().alias("triggers")
                     ).write.mode("overwrite").parquet(f"{alerts}/batch={batch_id}")
        versions.write(old.join(changed.select("symbol"), "symbol", "left_anti").unionByName(changed), batch_id)

    return (bars.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
