"""Session helpers: sensible defaults and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "barloom", cpus: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_LOCAL: dict[str, str] = {}  # temporary folder of a local session, by application


def work_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application.

    The shared folder the cluster names in ``spark.checkpoint.dir`` is used. A
    local session without one (tests, a laptop) gets a temporary folder; on a
    cluster the executors could not share it, so there it is an error. Removed
    when the application ends.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(app)
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/barloom-{app}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the work folder and read it back.

    Operators that read an input several times call this first, so a deep
    chain does not recompute its start once per reader. Unlike a checkpoint the
    table keeps column pruning, filter pushdown and size statistics, and it
    survives the loss of executors. A frame that is such a table is returned
    unchanged.
    """
    if getattr(df, "_stored", False):
        return df
    spark = df.sparkSession
    folder = work_folder(spark)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(conf).deleteOnExit(root)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored, out._path = True, path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` stored and nothing will read again (a table that its successor replaced)."""
    for df in frames:
        if path := getattr(df, "_path", None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
