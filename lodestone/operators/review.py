"""Findings to comments: de-duplication, consensus, bundles, clusters, quotas, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import severity_rank, terms_match


def best_issue(issues: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """Of issues with one key: pre-flagged first, then by confidence, severity, sequence."""
    w = Window.partitionBy(*key).orderBy(F.col("is_pre_flagged").desc(), F.col("confidence").desc(), severity_rank(F.col("severity")), *seq)
    return issues.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def segments(issues: DataFrame, key: list[str], near: int, start: str = "start_line", end: str = "end_line", seq: list[str] | None = None) -> DataFrame:
    """Adds group_no: a new group where the start lies more than `near` beyond every end before it."""
    w = Window.partitionBy(*key).orderBy(start, *(seq or []))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) - before > near), 1).otherwise(0)
    return issues.withColumn("__new", fresh).withColumn("group_no", F.sum("__new").over(w)).drop("__new")


def comment_groups(issues: DataFrame, key: list[str], near: int = 5, seq: list[str] | None = None) -> DataFrame:
    """key, group_no, line, end_line, severity, issues, confidence of each cluster of neighbouring issues."""
    s = segments(issues, key, near, seq=seq)
    return s.groupBy(*key, "group_no").agg(
        F.min("start_line").alias("line"), F.max("end_line").alias("end_line"), F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.count("*").alias("issues"), F.avg("confidence").alias("confidence")
    )


def consensus(issues: DataFrame, file: str, near: int = 3, boost: float = 0.15) -> DataFrame:
    """Issues within `near` lines of an anchor that come from two agents or more become one: the most severe, with more confidence.

    The anchor is the first issue that no cluster took. Issues further apart than `near` never meet, so files are first cut at
    such gaps and only a run of neighbours is folded at a time.
    """
    parts = segments(issues.withColumns({"__a": F.col("line"), "__b": F.col("line")}), [file], near, "__a", "__b", ["seq"])
    item = F.struct("line", "seq", "agent", severity_rank(F.col("severity")).alias("rank"), "severity", "confidence")
    runs = parts.groupBy(file, "group_no").agg(F.array_sort(F.collect_list(item)).alias("todo"))

    shape = "array<struct<line:int,seq:bigint,severity:string,confidence:double,others:string>>"

    def step(s: Column, x: Column) -> Column:
        taken = F.array_contains(s["taken"], x["seq"])
        around = F.filter("todo", lambda y: ~F.array_contains(s["taken"], y["seq"]) & (F.abs(y["line"] - x["line"]) <= near))
        agents = F.array_distinct(F.transform(around, lambda y: y["agent"]))
        winner = F.array_min(F.transform(around, lambda y: F.struct(y["rank"].alias("rank"), y["line"].alias("line"), y["seq"].alias("seq"), y["severity"].alias("severity"), y["confidence"].alias("confidence"), y["agent"].alias("agent"))))
        others = F.array_join(F.array_sort(F.filter(agents, lambda a: a != winner["agent"])), ",")
        both = F.size(agents) >= 2
        one = F.struct(x["line"].cast("int").alias("line"), x["seq"].cast("bigint").alias("seq"), x["severity"].alias("severity"), x["confidence"].cast("double").alias("confidence"), F.lit("").alias("others"))
        many = F.struct(winner["line"].cast("int").alias("line"), winner["seq"].cast("bigint").alias("seq"), winner["severity"].alias("severity"), F.least(winner["confidence"] + boost, F.lit(1.0)).alias("confidence"), others.alias("others"))
        after = F.struct(
            F.when(both, F.concat(s["taken"], F.transform(around, lambda y: y["seq"]))).otherwise(F.concat(s["taken"], F.array(x["seq"]))).alias("taken"),
            F.concat(s["out"], F.array(F.when(both, many).otherwise(one))).alias("out"),
        )
        return F.when(taken, s).otherwise(after)

    start = F.struct(F.array().cast("array<bigint>").alias("taken"), F.array().cast(shape).alias("out"))
    folded = runs.withColumn("done", F.aggregate("todo", start, step)["out"])
    return folded.select(file, F.explode("done").alias("d")).select(file, "d.*")


def bundles(chunks: DataFrame, file: list[str], order: list[str], most: int = 5, lines: int = 200) -> DataFrame:
    """Adds bundle: chunks of a file packed in order, a new one where `most` chunks or `lines` lines would be passed.

    `chunks` has n (lines). Only ids and counts are folded, a few bytes a chunk.
    """
    rows = chunks.groupBy(*file).agg(F.array_sort(F.collect_list(F.struct(*order, "n"))).alias("todo"))
    start = F.struct(F.lit(0).alias("no"), F.lit(0).alias("count"), F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = (s["count"] >= most) | ((s["count"] > 0) & (s["sum"] + x["n"] > lines)) | (s["no"] == 0)
        no = s["no"] + full.cast("int")
        return F.struct(no.alias("no"), F.when(full, 1).otherwise(s["count"] + 1).alias("count"), F.when(full, x["n"].cast("bigint")).otherwise(s["sum"] + x["n"]).alias("sum"), F.concat(s["out"], F.array(no)).alias("out"))

    packed = rows.withColumn("no", F.aggregate("todo", start, step)["out"])
    return packed.select(*file, F.explode(F.arrays_zip("todo", "no")).alias("z")).select(*file, "z.todo.*", F.col("z.no").alias("bundle"))


def budgeted(groups: DataFrame, file: str, seq: list[str], per_file: int = 5, total: int = 20) -> DataFrame:
    """Adds inline: CRITICAL groups always, others by severity and confidence while their file and the whole have room.

    Two rankings give what a greedy pass gives: a file admits a prefix of its groups, and once the whole is full nothing follows.
    The second ranking is over at most `per_file` groups a file; each file's are ranked first, so the last window is small.
    """
    order = [severity_rank(F.col("severity")), F.col("confidence").desc(), F.col(file), *seq]
    critical = F.col("severity") == "CRITICAL"
    counted = groups.withColumn("__c", F.sum(critical.cast("int")).over(Window.partitionBy(file)))
    ranked = counted.withColumn("__f", F.col("__c") + F.row_number().over(Window.partitionBy(file, critical).orderBy(*order)))
    fits = ~critical & (F.col("__f") <= per_file)
    all_critical = groups.agg(F.count_if(critical).alias("__all"))
    best = ranked.where(fits).orderBy(*order).limit(total).join(F.broadcast(all_critical))  # one row; at most `total` rows compete
    chosen = best.withColumn("__t", F.col("__all") + F.row_number().over(Window.orderBy(*order))).where(F.col("__t") <= total).select(file, *seq, F.lit(True).alias("__in"))
    return ranked.join(F.broadcast(chosen), [file, *seq], "left").withColumn("inline", critical | F.coalesce("__in", F.lit(False))).drop("__c", "__f", "__in")


def evidence_valid(line: Column, first: Column, last: Column, evidence: Column, known: Column) -> Column:
    """Whether a finding's line lies in its chunk and each of its terms matches a known one (blank terms don't count)."""
    cited = F.filter(evidence, lambda e: F.trim(e) != "")
    return line.between(first, last) & F.forall(cited, lambda e: F.exists(known, lambda k: terms_match(e, k)))


def snippet(lines: Column, first: Column, last: Column, around: int = 3) -> Column:
    """The lines around a finding, numbered."""
    start = F.greatest(F.lit(1), first - around)
    cut = F.slice(lines, start, F.greatest(F.lit(0), F.least(F.size(lines), last + around) - start + 1))
    return F.array_join(F.transform(cut, lambda x, i: F.concat((start + i).cast("string"), F.lit(": "), x)), "\n")
