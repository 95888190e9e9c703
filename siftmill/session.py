"""Session helpers: settings, table loading, and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that hold at every size; sizes (partitions, memory) are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session for tests and bench runs on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("siftmill")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    make_importable(spark)
    return spark


def make_importable(spark: SparkSession) -> None:
    """Let the Python workers find this package where it is, and send it to them on a cluster that may not have it there."""
    root = str(Path(__file__).resolve().parents[1])
    context = spark.sparkContext
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root in paths:
        return
    context.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if not context.master.startswith("local"):
        with tempfile.TemporaryDirectory() as folder:  # of the driver; Spark's file server takes a copy
            context.addPyFile(shutil.make_archive(os.path.join(folder, "siftmill"), "zip", root, "siftmill"))


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the Parquet tables below base."""
    make_importable(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and all runs on one machine (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = spark.sparkContext.getConf().get("spark.app.id", "app")
    path = os.path.join(tempfile.gettempdir(), f"siftmill-{os.getpid()}-{made}")
    if not os.path.isdir(path):
        os.makedirs(path)
        atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def stage(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df as a table into the shared folder and read it back: cuts the lineage and survives lost executors.

    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftmill-stage/{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of two numbers that are sent to every executor at most (some 8 MB).
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than most rows, counted first; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
