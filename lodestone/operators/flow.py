"""The review's flow as tables: what is reviewed, what rules and reviewers found, and what remains after de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import head_lines, severity_rank
from lodestone.operators import review
from lodestone.operators.context import security_path

#: The columns of an issue, in order.
ISSUE = ("chunk_id", "rule_id", "severity", "title", "description", "file_path", "start_line", "end_line", "suggestion", "language", "category", "agent", "is_pre_flagged", "confidence", "layer")
#: Answers that no retry mends, the wait after too many requests in seconds, and what is added to a server's own.
FATAL, RATE_LIMITED, RATE_WAIT, RATE_EXTRA = (400, 401, 403), 429, 15.0, 0.5


def with_category(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds category: that of the row's rule (rules has rule_id, category), else 'general'. A rule named twice has its least category."""
    known = rules.groupBy("rule_id").agg(F.min("category").alias("category"))
    return rows.join(known, "rule_id", "left").withColumn("category", F.coalesce("category", F.lit("general")))


def preflagged(violations: DataFrame, chunks: DataFrame, rules: DataFrame) -> DataFrame:
    """Issues (see ISSUE) of what the mechanical rules found: certain, and on one line.

    `violations` has chunk_id, rule_id, severity, line; `chunks` has chunk_id (once), file_path, language, layer; `rules` rule_id, category, title, description.
    """
    words = rules.groupBy("rule_id").agg(F.min(F.struct("category", "title", "description")).alias("rule"))
    j = violations.join(words, "rule_id", "left").join(chunks.select("chunk_id", "file_path", "language", "layer"), "chunk_id")
    hint = F.concat(F.lit("See rule "), "rule_id", F.lit(" in standards/"), F.coalesce("language", F.lit("unknown")), F.lit(".md for the required fix."))
    return j.select(
        "chunk_id", "rule_id", "severity", F.coalesce("rule.title", "rule_id").alias("title"), F.coalesce("rule.description", F.lit("")).alias("description"), "file_path", F.col("line").cast("int").alias("start_line"), F.col("line").cast("int").alias("end_line"),
        hint.alias("suggestion"), "language", F.coalesce("rule.category", F.lit("general")).alias("category"), F.lit("general").alias("agent"), F.lit(True).alias("is_pre_flagged"), F.lit(1.0).alias("confidence"), "layer",
    )


def radius_notes(chunks: DataFrame, radius: DataFrame, least: int = 50) -> DataFrame:
    """An INFO issue, in place of a review, for each chunk that calls or is called by `least` others or more; radius has node, radius."""
    j = chunks.join(radius.where(F.col("radius") >= least).select(F.col("node").alias("chunk_id"), "radius"), "chunk_id")
    text = F.concat(F.coalesce("symbol_name", F.lit("")), F.lit(" has "), F.col("radius").cast("string"), F.lit(f" direct callers and callees, at or above the threshold ({least})."))
    return j.select(
        "chunk_id", F.lit("ARCH005").alias("rule_id"), F.lit("INFO").alias("severity"), F.lit("Wide blast radius, reviewed at reduced depth").alias("title"), text.alias("description"), "file_path", "start_line", "end_line",
        F.lit("Look at this chunk by hand.").alias("suggestion"), "language", F.lit("architecture").alias("category"), F.lit("general").alias("agent"), F.lit(False).alias("is_pre_flagged"), F.lit(1.0).alias("confidence"), "layer",
    )


def together(*sources: DataFrame) -> DataFrame:
    """All issues of several sources, duplicates included."""
    out = sources[0].select(*ISSUE)
    for s in sources[1:]:
        out = out.unionByName(s.select(*ISSUE))
    return out


def deduplicated(issues: DataFrame, least: float = 0.5, near: int = 3, boost: float = 0.15) -> DataFrame:
    """Issues without those below `least` confidence, one per file, line and rule, and one where several agents agree nearby.

    Adds corroborated_by (the other agents, joined by commas). A null confidence is below any. Ties between equal issues: by chunk, then title.
    """
    best = review.best_issue(issues.where(F.col("confidence") >= least), ["file_path", "start_line", "rule_id"], ["chunk_id", "title", "agent"])
    # a number of its own for each issue, from its content: the same on every run
    keyed = best.withColumn("seq", F.xxhash64("file_path", "start_line", "rule_id"))
    merged = review.consensus(keyed.select("file_path", F.col("start_line").alias("line"), "seq", "agent", "severity", "confidence"), "file_path", near, boost)
    won = merged.select(F.col("file_path").alias("__f"), F.col("seq").alias("__s"), F.col("confidence").alias("__c"), F.col("others").alias("corroborated_by"))
    same = keyed["file_path"].eqNullSafe(won["__f"]) & (keyed["seq"] == won["__s"])
    return keyed.join(won, same).withColumn("confidence", F.col("__c")).drop("__f", "__s", "__c", "seq")


def ordered(issues: DataFrame, *more: str) -> DataFrame:
    """By severity, file and line (then rule and whatever else tells them apart)."""
    return issues.orderBy(severity_rank(F.col("severity")), "file_path", "start_line", "rule_id", *more)


def gated(issues: DataFrame, decision: DataFrame) -> DataFrame:
    """Issues of the repositories whose ingestion was not aborted; decision has repo_name, decision. One without a decision stays."""
    return issues.join(decision.where(F.col("decision") == "ABORT").select("repo_name"), "repo_name", "left_anti")


def queue(order: DataFrame, most: int = 300) -> DataFrame:
    """chunk_id, place: the first `most` chunks by tier, then lines (the longest first), then id; 0 takes all (chunk_id, tier, lines of `review_order`)."""
    by = [F.col("tier"), F.col("lines").desc(), F.col("chunk_id")]
    if most:  # a top-k: each task keeps its best, and the window has no more than `most` rows
        return order.orderBy(*by).limit(most).select("chunk_id", F.row_number().over(Window.orderBy(*by)).alias("place"))
    # all places without a window over everything: ranks within a tier and length, on top of the counts before them
    sizes = order.groupBy("tier", "lines").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("tier", F.col("lines").desc()).rowsBetween(Window.unboundedPreceding, -1)))  # as many rows as there are lengths
    rank = F.row_number().over(Window.partitionBy("tier", "lines").orderBy("chunk_id"))
    return order.withColumn("r", rank).join(before, ["tier", "lines"]).select("chunk_id", (F.coalesce("before", F.lit(0)) + F.col("r")).cast("int").alias("place"))


def depth(pre_flagged: Column, path: Column) -> Column:
    """'full' for chunks that rules flagged or whose path is sensitive, else 'fast'."""
    return F.when(F.coalesce(pre_flagged, F.lit(False)) | security_path(path), "full").otherwise("fast")


def attributed(findings: DataFrame, bundles: DataFrame) -> DataFrame:
    """Findings on bundles (bundle_id, chunk_index) with the chunk_id they mean; those whose index is none of the bundle's are dropped.

    `bundles` has bundle_id, position (from 0), chunk_id.
    """
    at = bundles.select("bundle_id", F.col("position").alias("chunk_index"), "chunk_id")
    return findings.where(F.col("chunk_index") >= 0).join(at, ["bundle_id", "chunk_index"])


def architecture_notes(chunks: DataFrame, violations: DataFrame, cycles: DataFrame, orphans: DataFrame, coupled: DataFrame, most_cycles: int = 10) -> DataFrame:
    """chunk_id, kind, detail: what the graph says of each chunk.

    Layer violations count for all chunks of the calling file (violations has file_path, detail); of the cycles (cycle, members: an array) the first
    `most_cycles` by name count; orphans and coupled have node (and n_out).
    """
    by_file = chunks.select("chunk_id", "file_path").join(violations, "file_path").select("chunk_id", F.lit("layer_violation").alias("kind"), "detail")
    first = cycles.orderBy("cycle").limit(most_cycles)
    in_cycle = first.select(F.explode("members").alias("chunk_id"), F.lit("cycle").alias("kind"), F.col("cycle").alias("detail"))
    alone = orphans.select(F.col("node").alias("chunk_id"), F.lit("orphan").alias("kind"), F.lit("").alias("detail"))
    wide = coupled.select(F.col("node").alias("chunk_id"), F.lit("high_coupling").alias("kind"), F.col("n_out").cast("string").alias("detail"))
    known = chunks.select("chunk_id").distinct()
    return by_file.unionByName(in_cycle).unionByName(alone).unionByName(wide).join(known, "chunk_id", "left_semi").distinct()


def prompts(chunks: DataFrame, context: DataFrame, rules: DataFrame, flagged: DataFrame, most: int = 150) -> DataFrame:
    """chunk_id, prompt: a chunk's place, what rules found in it, its context, the rules for its language and its first `most` lines.

    `context` has chunk_id, text; `rules` language, text; `flagged` chunk_id, rule_id, line. Sections without content are left out.
    """
    found = flagged.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("line", "rule_id"))), lambda x: F.concat(F.lit("- "), x["rule_id"], F.lit(" at line "), x["line"].cast("string"))), "\n").alias("found"))
    j = chunks.join(found, "chunk_id", "left").join(context.select("chunk_id", F.col("text").alias("context")), "chunk_id", "left").join(rules.select("language", F.col("text").alias("rules")), "language", "left")
    section = lambda title, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), F.col(c)))
    place = F.concat(F.lit("File: "), F.coalesce("file_path", F.lit("")), F.lit("\nSymbol: "), F.coalesce("symbol_name", F.lit("")))
    code = F.concat(F.lit("## Code\n"), head_lines(F.coalesce("content", F.lit("")), most))
    return j.select("chunk_id", F.concat_ws("\n\n", place, section("Already flagged", "found"), section("Context", "context"), section("Rules", "rules"), code).alias("prompt"))


def retry_delay(status: Column, retry_after: Column, attempt: Column) -> Column:
    """Seconds to wait before the next of three tries: null if none helps; after too many requests the server's own wait or a fixed one; else doubling."""
    own = retry_after.try_cast("double")
    return F.when(status.isin(*FATAL) | (attempt >= 3), F.lit(None).cast("double")).when(status == RATE_LIMITED, F.coalesce(own + RATE_EXTRA, F.lit(RATE_WAIT))).otherwise(F.pow(F.lit(2.0), attempt))


def stats(selected: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: chunks selected and by depth, issues before any de-duplication, pre-flagged ones, chunks with issues."""
    s = selected.agg(F.count("*").alias("selected"), F.count_if(F.col("depth") == "full").alias("full_depth"))
    i = issues.agg(F.count("*").alias("issues"), F.count_if("is_pre_flagged").alias("pre_flagged"), F.count_distinct("chunk_id").alias("chunks_with_issues"))
    return s.join(F.broadcast(i))  # one row each
