"""Ingestion quality: exclusive quantiles, metrics, graded dimensions and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the dimensions, scores of grades, default thresholds (good, fair) and whether more is better.
WEIGHTS = {"IQ-01": 20, "IQ-02": 10, "IQ-03": 20, "IQ-04": 10, "IQ-05": 20, "IQ-06": 10, "IQ-07": 10}
SCORES = {"PASS": 100, "WARN": 50, "FAIL": 0, "SKIP": 100}
DEFAULTS = {"IQ-01": (0.80, 0.60, True), "IQ-02": (5.0, 2.0, True), "IQ-03": (0.50, 0.30, True), "IQ-04": (0.20, 0.40, False), "IQ-05": (150.0, 250.0, False), "IQ-07": (0.95, 0.80, True)}
#: Thresholds of single languages.
BY_LANGUAGE = {
    "IQ-01": {"dart": (0.68, 0.48), "javascript": (0.68, 0.48), "typescript": (0.73, 0.53)},
    "IQ-02": {"dart": (3.0, 1.5), "java": (3.0, 1.5), "kotlin": (4.0, 2.0), "swift": (4.0, 2.0), "javascript": (4.0, 1.5), "typescript": (4.0, 1.5), "python": (5.0, 2.0), "rust": (6.0, 3.0)},
    "IQ-03": {"kotlin": (0.60, 0.40), "java": (0.60, 0.40), "dart": (0.55, 0.35), "swift": (0.55, 0.35), "rust": (0.60, 0.40), "python": (0.42, 0.22), "javascript": (0.32, 0.18), "typescript": (0.44, 0.24)},
    "IQ-04": {"dart": (0.30, 0.52), "javascript": (0.35, 0.55), "typescript": (0.30, 0.50), "python": (0.25, 0.45)},
    "IQ-05": {"dart": (120.0, 200.0), "kotlin": (130.0, 220.0), "java": (200.0, 350.0), "swift": (130.0, 220.0), "python": (120.0, 200.0), "javascript": (100.0, 180.0), "typescript": (100.0, 180.0), "rust": (150.0, 260.0)},
}


#: Below how many cycles and which share of orphans a graph is healthy, by language.
GRAPH = {"default": (5, 0.10), "dart": (5, 0.18), "kotlin": (5, 0.15), "swift": (5, 0.15), "javascript": (8, 0.12), "typescript": (6, 0.12)}


def p95(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, p95: the 95th percentile by the exclusive method (it may go beyond the greatest value of a small group; one value is itself).

    Equal values are counted first, so a group's data is its distinct values; the two order statistics are found by running sums.
    """
    from pyspark.sql import Window

    c = counts.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*by).orderBy(value)
    r = c.withColumns({"__to": F.sum("__k").over(w), "__n": F.sum("__k").over(Window.partitionBy(*by))})
    j = F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.floor(95 * (F.col("__n") + 1) / 100)))
    at = lambda i: F.min(F.when(F.col("__to") >= i, F.col(value)))
    g = r.groupBy(*by, "__n").agg(at(j).alias("__lo"), at(j + 1).alias("__hi"))
    d = 95 * (F.col("__n") + 1) - 100 * j
    return g.select(*by, F.when(F.col("__n") == 1, F.col("__lo").cast("double")).otherwise((F.col("__lo") * (100 - d) + F.col("__hi") * d) / 100).alias("p95"))


def thresholds(spark) -> DataFrame:
    """dim, language, good, fair, higher; language 'default' for those without an entry."""
    rows = [(k, "default", a, b, h) for k, (a, b, h) in DEFAULTS.items()] + [(k, lang, a, b, DEFAULTS[k][2]) for k, v in BY_LANGUAGE.items() for lang, (a, b) in v.items()]
    return spark.createDataFrame(rows, "dim string, language string, good double, fair double, higher boolean")


def graded(values: DataFrame) -> DataFrame:
    """Adds status and score to rows of (dim, language, value); a null value is skipped."""
    t = thresholds(values.sparkSession)
    own = t.where("language <> 'default'").select("dim", "language", F.struct("good", "fair", "higher").alias("own"))
    base = t.where("language = 'default'").select("dim", F.struct("good", "fair", "higher").alias("base"))
    j = values.join(F.broadcast(own), ["dim", "language"], "left").join(F.broadcast(base), "dim").withColumn("t", F.coalesce("own", "base"))  # about 50 rows
    hit = lambda c: F.when(F.col("t.higher"), F.col("value") >= F.col(f"t.{c}")).otherwise(F.col("value") < F.col(f"t.{c}"))
    status = F.when(F.col("value").isNull(), "SKIP").when(hit("good"), "PASS").when(hit("fair"), "WARN").otherwise("FAIL")
    score = F.when(status == "SKIP", 100).when(status == "PASS", 100).when(status == "WARN", 50).otherwise(0)
    return j.select(*values.columns, status.alias("status"), score.alias("score"))


def graph_health(values: DataFrame) -> DataFrame:
    """Status and score of IQ-06 for rows with language, cycles, orphan_rate: PASS if both are below their limits, WARN if one is. A null language counts as default."""
    limit = lambda i: F.coalesce(F.create_map(*(F.lit(x) for k, v in GRAPH.items() for x in (k, float(v[i]))))[F.coalesce("language", F.lit("default"))], F.lit(float(GRAPH["default"][i])))
    good = (F.col("cycles") < limit(0)).cast("int") + (F.col("orphan_rate") < limit(1)).cast("int")
    return values.withColumn("status", F.when(good == 2, "PASS").when(good == 1, "WARN").otherwise("FAIL")).withColumn("score", good * 50)


def _weight(dim: Column) -> Column:
    out = F.lit(0)
    for k, v in WEIGHTS.items():
        out = F.when(dim == k, v).otherwise(out)
    return out


def decision(dims: DataFrame, by: list[str]) -> DataFrame:
    """by, overall (weighted mean, half to even), decision, worst (the first dimension of the least score that isn't skipped)."""
    w = _weight(F.col("dim"))
    g = dims.groupBy(*by).agg(F.bround(F.sum(w * F.col("score")) / F.sum(w)).cast("int").alias("overall"), F.min_by("dim", F.when(F.col("status") != "SKIP", F.struct("score", "dim"))).alias("worst"))
    return g.select(*by, "overall", F.when(F.col("overall") >= 70, "PROCEED").when(F.col("overall") >= 50, "WARN").otherwise("ABORT").alias("decision"), "worst")
