"""Decisions as a stream: late and repeated deliveries, running counts, a budget, keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators.ingest import upsert


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """New Parquet files below path as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def without_repeats(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Each key once while its repeats come within the lateness."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_failures(stream: DataFrame, at: str = "created_at", late: str | None = "1 hour", width: str = "1 hour") -> DataFrame:
    """Failures by note in windows of event time; a window is final once the watermark has passed it.

    late is None where the stream has its watermark already.
    """
    failed = (stream.withWatermark(at, late) if late else stream).filter(~F.col("span_verified"))
    return failed.groupBy(F.window(at, width).alias("w"), F.coalesce("verify_note", F.lit("")).alias("note")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "note", "n")


def upsert_into(path: str, keys: list[str], at: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the latest row of every key in a table; a repeated batch changes nothing.

    Versions are written beside each other and named by their batch, so a failed batch leaves the last one whole.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = []
        if fs.exists(root):
            done = sorted(int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        done = [d for d in done if d < number]
        old = spark.read.schema(batch.schema).parquet(f"{path}/{done[-1]}") if done else batch.limit(0)
        upsert(old, batch, keys, at).write.mode("overwrite").parquet(f"{path}/{number}")
        for d in done[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{d}"), True)

    return merge
