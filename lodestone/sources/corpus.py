"""Corpus sources and sinks: directory scans, texts, event logs, graphs, versioned tables."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import lines


def scan(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """repo_name, path, size_bytes, last_modified, extension, content_bytes of every file below a folder.

    Size and path filters reach the scan; the bytes are read only by queries that use them.
    """
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    below = F.substring(path, F.length(F.lit(root.rstrip("/"))) + 2, F.lit(1 << 20))
    name = F.element_at(F.split(below, "/"), -1)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.select(F.lit(repo).alias("repo_name"), below.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"), F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)).alias("extension"), F.col("content").alias("content_bytes"))


def text_of(content: Column) -> Column:
    """Bytes as UTF-8 text; bytes that are none become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def with_lines(files: DataFrame) -> DataFrame:
    """Adds content and its lines to scanned files."""
    return files.withColumn("content", text_of(F.col("content_bytes"))).withColumn("raw_lines", lines(F.col("content")))


def changed_files(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """key of files that were added or whose digest changed; deletions don't count."""
    return new.join(old.select(*key, F.col(digest).alias("__old")), key, "left").where(~F.col(digest).eqNullSafe(F.col("__old"))).select(*key, digest)


def write_chunks(chunks: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Chunks as Parquet (by repository) or JSON lines."""
    w = chunks.write.mode("overwrite")
    (w.partitionBy("repo_name").parquet(path) if fmt == "parquet" else w.json(path))


def read_chunks(spark: SparkSession, path: str, columns: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """Chunks with the columns (name to type) expected; those that older writers left out are null."""
    df = spark.read.format(fmt).load(path)
    return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))


def record_event(spark: SparkSession, folder: str, run_id: str, event_type: str, **fields) -> None:
    """One event appended to a log as a JSON line in a file of its own; a field that can't be written is left out."""
    row = {"ts": time.time(), "run_id": run_id, "event_type": event_type}
    for k, v in fields.items():
        try:
            json.dumps(v)
            row[k] = v
        except (TypeError, ValueError):
            pass
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{uuid.uuid4().hex}.json")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
    out.write((json.dumps(row) + "\n").encode())
    out.close()


def read_events(spark: SparkSession, folder: str, event_type: str | None = None) -> DataFrame:
    """ts, run_id, event_type, fields (the line's JSON); lines that are no events are skipped."""
    raw = spark.read.text(folder).where(F.trim("value") != "")
    e = raw.select(F.from_json("value", "ts double, run_id string, event_type string", {"mode": "PERMISSIVE"}).alias("e"), F.col("value").alias("fields"))
    out = e.where("e.ts IS NOT NULL AND e.event_type IS NOT NULL").select("e.*", "fields")
    return out if event_type is None else out.where(F.col("event_type") == event_type)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """An upsert: the new rows, and of the old those that no new row replaces."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)


def to_upsert(existing: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """The new rows whose digest differs from the stored one, or that have none stored."""
    return changed_files(existing, new, key, digest)


def patched(rows: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with columns replaced where a patch has a value for them."""
    p = patch.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    j = rows.join(p, key, "left")
    return j.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*(f"__{c}" for c in columns))
