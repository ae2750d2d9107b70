"""Event streams: watermarked windows, sessions, de-duplication, and upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.corpus import merged

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total per window; rows later than the watermark are dropped and state with them."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n of each session."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert_to(folder: str, key: list[str]):
    """A foreachBatch sink: each batch is merged into a new version of a table, and a pointer names the last whole one.

    A batch that comes again after a failure writes the same version, so nothing is applied twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        before = [n for n in versions(spark, folder) if n < number]
        new = batch.dropDuplicates(key)
        whole = merged(spark.read.parquet(f"{folder}/v{before[-1]}"), new, key) if before else new
        whole.write.mode("overwrite").parquet(f"{folder}/v{number}")
        fs.create(path(f"{folder}/done/{number}"), True).close()

    return apply


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the whole versions."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/done")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(at)) if fs.exists(at) else []
