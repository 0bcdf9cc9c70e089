"""Append-only tables: experiments, decisions, seen items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.session import cut


def data_hash(bars: DataFrame, by=()) -> DataFrame:
    """16 hex digits over first close, last close and count of every symbol.

    Symbols are hashed in 256 groups and the group digests once more, so no row
    ever gathers all symbols.
    """
    per = bars.groupBy(*by, "symbol").agg(F.min_by("close", "ts").alias("a"), F.max_by("close", "ts").alias("b"), F.count(F.lit(1)).alias("n"))
    text = F.concat_ws(":", "symbol", F.format_string("%.6f", "a"), F.format_string("%.6f", "b"), F.col("n").cast("string"))
    def digest(c) -> Column:
        return F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "|"), 256)
    group = F.substring(F.sha2("symbol", 256), 1, 2).alias("_g")
    part = per.groupBy(*by, group).agg(F.concat("_g", digest(text)).alias("_d"))
    return part.groupBy(*by).agg(F.substring(digest("_d"), 1, 16).alias("data_hash"))


def experiment_id(config: Column, data: Column, parameters: Column, model: Column) -> Column:
    """12 hex digits of the configuration, data, parameters and model name."""
    return F.substring(F.sha2(F.concat(config, data, parameters, model), 256), 1, 12)


def content_id(title: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat(title, url), 256), 1, 12)


def period_issues(records: DataFrame, min_hypothesis: int = 20) -> DataFrame:
    """Rows that must not be registered, with the reason.

    Periods read 'start to end'; the train end must precede the test start.
    """
    def side(c: str, k: int) -> Column:
        return F.to_date(F.trim(F.get(F.split(c, "to"), F.lit(k))))
    overlap = F.coalesce(side("train_period", 1) >= side("test_period", 0), F.lit(False))
    short = F.length(F.trim(F.coalesce("hypothesis", F.lit("")))) < min_hypothesis
    reason = F.when(overlap, "train overlaps test").when(short, "hypothesis too short")
    return records.withColumn("issue", reason).where(F.col("issue").isNotNull())


def register(records: DataFrame, path: str) -> DataFrame:
    """Append valid experiment records once; returns what was new.

    ``records`` has experiment_id, train_period, test_period, hypothesis, ....
    Invalid records raise.
    """
    records = cut(records)
    bad = period_issues(records).select("experiment_id", "issue").limit(1).collect()
    if bad:
        raise ValueError(f"experiment {bad[0][0]}: {bad[0][1]}")
    new = cut(unseen(records, load(records.sparkSession, path, records), "experiment_id"))
    new.write.mode("append").parquet(path)
    return new


def load(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Stored rows, or an empty frame with the columns of ``like``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return like.where(F.lit(False))
    return spark.read.schema(like.schema).parquet(path)


def export_record(spark: SparkSession, path: str, experiment: str, out: str) -> None:
    """One record as json."""
    spark.read.parquet(path).where(F.col("experiment_id") == experiment).write.mode("overwrite").json(out)


def list_records(spark: SparkSession, path: str, *order: str) -> DataFrame:
    """All records with their place in the given order, ties by experiment_id.

    Records are experiments, few by nature, so the numbering runs in one window.
    """
    by = Window.orderBy(*order, "experiment_id")
    return spark.read.parquet(path).withColumn("place", F.row_number().over(by).cast("bigint"))


def export_records(records: DataFrame, out: str) -> None:
    """Records as json lines."""
    records.write.mode("overwrite").json(out)


def unseen(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Items whose key is not in the ledger."""
    return items.join(seen.select(key).distinct(), key, "left_anti")


def append_seen(items: DataFrame, path: str, key: str = "id") -> None:
    """Add the keys that the ledger does not have yet."""
    keys = items.select(key).distinct()
    cut(unseen(keys, load(keys.sparkSession, path, keys), key)).write.mode("append").parquet(path)


def decision_log(canaries: DataFrame, regime: DataFrame, layers: DataFrame, weights: DataFrame) -> DataFrame:
    """One explained row per date.

    Inputs are long tables with ``ts``: canaries(name, signal, value,
    confidence), regime(regime, confidence), layers(layer, regime),
    weights(symbol, weight). Per date they hold one row per canary, layer or
    held symbol.
    """
    c = canaries.groupBy("ts").agg(
        F.array_sort(F.collect_list(F.struct("name", "signal", "value", "confidence"))).alias("canaries"),
        F.count_if(F.col("signal") == "RiskOn").alias("risk_on_votes"), F.count_if(F.col("signal") == "RiskOff").alias("risk_off_votes"))
    la = layers.groupBy("ts").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "regime")))).alias("regime_layers"))
    w = weights.groupBy("ts").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "weight")))).alias("portfolio_weights"))
    df = regime.select("ts", F.col("regime").alias("final_regime"), "confidence").join(c, "ts").join(la, "ts", "left").join(w, "ts", "left")
    first = F.array_join(F.transform(F.slice("canaries", 1, 4), lambda x: F.concat(x["name"], F.lit(" "), x["signal"])), "; ")
    text = F.format_string("On %s: regime %s, confidence %.4f. Votes %d on, %d off. Canaries: %s.", F.date_format("ts", "yyyy-MM-dd"),
                           F.col("final_regime"), F.col("confidence"), F.col("risk_on_votes"), F.col("risk_off_votes"), first)
    return df.withColumn("human_readable", text)


def export_log(log: DataFrame, path: str) -> None:
    """Nested columns as json."""
    log.write.mode("overwrite").json(path)
