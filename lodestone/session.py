"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine relies on; everything else stays as the cluster has it.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    b = SparkSession.builder.master(master).appName("lodestone").config("spark.driver.memory", memory)
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false"} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one on a local master only.

    On a cluster without the setting this raises, as a machine-local folder would lose data with its executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="lodestone-")
    return found


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder; it survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, *keys: str) -> DataFrame:
    """As `cut`, but hash-partitioned by keys, and known to be: later joins on the keys don't move these rows again.

    Of several rows with the same keys one stays; who expects many of them combines them before. A plan that is adapted while it runs doesn't tell its
    partitioning, so this one is planned without adaptation; other threads' plans of the same session may be, too, meanwhile, which
    changes their speed, not their rows.
    """
    spark = df.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return cut(df.repartition(wide, *keys).dropDuplicates(list(keys)))
    finally:
        spark.conf.set(name, before)
