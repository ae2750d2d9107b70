"""Stores as tables: chunks for retrieval, a lexical index, golden cases and stage events. No service is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.corpus import merged

#: The fields that a stored chunk has, in order.
PAYLOAD = (
    "chunk_id string, repo_name string, file_path string, language string, chunk_type string, symbol_name string, start_line int, end_line int, parent_symbol string, parent_chunk_id string, prev_chunk_id string, next_chunk_id string, "
    "summary string, content string, layer string, layers array<string>, violations array<string>, content_hash string"
)
#: The schema of a saved lexical index.
POSTINGS = "term string, chunk_id string, dl int, tf bigint"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def payload(chunks: DataFrame, violations: DataFrame) -> DataFrame:
    """The fields of PAYLOAD for each chunk; a missing summary is '', violations (chunk_id, rule_id) become a sorted list of rules, each once.

    `layers` is the list of a chunk's layers; where there is no such column it's the one layer. Chunks delivered twice count once.
    """
    rules = violations.groupBy("chunk_id").agg(F.array_sort(F.collect_set("rule_id")).alias("violations"))
    c = chunks if "layers" in chunks.columns else chunks.withColumn("layers", F.array("layer"))
    c = c.withColumn("summary", F.coalesce("summary", F.lit(""))).drop("violations").dropDuplicates(["chunk_id"]).join(rules, "chunk_id", "left")
    c = c.withColumn("violations", F.coalesce("violations", F.array().cast("array<string>")))
    return c.select(*(F.col(f.split()[0]).cast(f.split(maxsplit=1)[1]).alias(f.split()[0]) for f in PAYLOAD.split(", ")))


class ChunkStore:
    """Stored chunks: a folder of versions; the newest that was written completely counts.

    A version is a whole table, so readers never see half an upsert, and a failed one leaves what was there.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _version(self) -> int:
        p, fs = _fs(self.spark, self.folder)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        done = [int(n) for n in names if n.isdigit() and fs.exists(_fs(self.spark, f"{self.folder}/{n}/_SUCCESS")[0])]
        return max(done, default=0)

    def ensure(self, recreate: bool = False) -> None:
        """Makes an empty store where there is none, or in any case."""
        if recreate or not self._version():
            self._write(self.spark.createDataFrame([], PAYLOAD))

    def _write(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.folder}/{self._version() + 1}")

    def read(self) -> DataFrame:
        n = self._version()
        return self.spark.read.parquet(f"{self.folder}/{n}") if n else self.spark.createDataFrame([], PAYLOAD)

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those with their chunk_id; of several rows for one id any stays, so they should be equal. Null ids are left out."""
        new = rows.where(F.col("chunk_id").isNotNull()).dropDuplicates(["chunk_id"])
        self._write(merged(self.read(), new, ["chunk_id"]))

    def by_id(self, *ids: str) -> DataFrame:
        return self.read().where(F.col("chunk_id").isin(*ids))

    def by_file(self, repo_name: str, file_path: str, most: int = 100) -> DataFrame:
        """Up to `most` chunks of a file, in order."""
        return self.read().where((F.col("repo_name") == repo_name) & (F.col("file_path") == file_path)).orderBy("start_line", "chunk_id").limit(most)


def save_index(postings: DataFrame, path: str) -> None:
    """Postings (term, chunk_id, dl, tf), laid out by term, so that a search reads few of them."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """A saved index; where there is none an empty one, in which nothing is found."""
    p, fs = _fs(spark, path)
    return spark.read.parquet(path) if fs.exists(p) else spark.createDataFrame([], POSTINGS)


def golden_cases(spark: SparkSession, folder: str) -> DataFrame:
    """name, category, language, chunk_type, layer, description, must_find, must_not_find, content of all cases below a folder.

    A case is a folder with expected.json and one input file; cases right below have the category 'misc'. What expected.json leaves out is empty,
    the layer 'unknown'. A folder without either file, or with a file that is no JSON, is no case.
    """
    p, fs = _fs(spark, folder)
    schema = "name string, category string, language string, chunk_type string, layer string, description string, must_find array<struct<rule_id:string,severity:string>>, must_not_find array<struct<rule_id:string,severity:string>>, content string"
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    texts = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.split(F.regexp_replace(F.input_file_name(), r"^.*?" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", ""), "/").alias("at"), F.col("value").alias("text"))
    own = texts.where(F.size("at").isin(2, 3)).select(F.array_join(F.slice("at", 1, F.size("at") - 1), "/").alias("case"), F.element_at("at", -1).alias("file"), "text")
    rules = "array<struct<rule_id:string,severity:string>>"
    what = own.where("file = 'expected.json'").select("case", F.from_json("text", f"description string, language string, chunk_type string, layer string, must_find {rules}, must_not_find {rules}").alias("e")).where("e.language IS NOT NULL")
    code = own.where("file LIKE 'input.%'").groupBy("case").agg(F.min_by("text", "file").alias("content"))
    parts = F.split("case", "/")
    none = F.array().cast(rules)
    return what.join(code, "case").select(
        F.element_at(parts, -1).alias("name"), F.when(F.size(parts) > 1, parts[0]).otherwise("misc").alias("category"), "e.language", "e.chunk_type", F.coalesce("e.layer", F.lit("unknown")).alias("layer"),
        F.coalesce("e.description", F.lit("")).alias("description"), F.coalesce("e.must_find", none).alias("must_find"), F.coalesce("e.must_not_find", none).alias("must_not_find"), "content",
    )


def stage_spans(events: DataFrame) -> DataFrame:
    """run_id, stage, started, ended, ok, ms: a stage's start with its first end after it; an end that never came leaves ended, ok and ms null.

    `events` has run_id, ts (seconds), event_type ('stage_start' or 'stage_end'), stage, ok. An end without a start is left out.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("run_id", "stage").orderBy("ts", F.col("event_type") != "stage_end")
    e = events.where(F.col("event_type").isin("stage_start", "stage_end"))
    n = e.withColumns({"__t": F.lead("event_type").over(w), "__at": F.lead("ts").over(w), "__ok": F.lead("ok").over(w)}).where("event_type = 'stage_start'")
    ends = F.col("__t") == "stage_end"
    return n.select("run_id", "stage", F.col("ts").alias("started"), F.when(ends, F.col("__at")).alias("ended"), F.when(ends, F.col("__ok")).alias("ok"), F.when(ends, F.round((F.col("__at") - F.col("ts")) * 1000)).cast("bigint").alias("ms"))
