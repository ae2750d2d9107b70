"""What a finding's review needs: risk, routing, order, context, decisions, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import head_lines, html_escaped, severity

#: Parts of a path that mark it as sensitive.
SECURITY_PATHS = ("auth", "crypt", "token", "password", "secret", "jwt", "oauth", "signin", "login", "session", "credential", "key", "permission", "role", "access", "secure")
#: Rule categories that always apply.
BASELINE = ("complexity", "error_handling", "security", "style")


def security_path(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike("|".join(SECURITY_PATHS)), F.lit(False))


def risk_signals(chunks: DataFrame, radius: DataFrame, orphans: DataFrame, coupled: DataFrame, flagged: DataFrame, changed: DataFrame) -> DataFrame:
    """chunk_id, blast_radius and flags of each chunk; the other tables have a column node (and radius), each node once."""
    out = chunks.select("chunk_id", "file_path").join(radius.select(F.col("node").alias("chunk_id"), "radius"), "chunk_id", "left")
    for name, table in (("is_orphan", orphans), ("is_high_coupling", coupled), ("is_pre_flagged", flagged), ("is_changed", changed)):
        out = out.join(table.select(F.col("node").alias("chunk_id"), F.lit(True).alias(name)), "chunk_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.select("chunk_id", F.coalesce("radius", F.lit(0)).alias("blast_radius"), "is_orphan", "is_high_coupling", security_path(F.col("file_path")).alias("is_security_path"), "is_pre_flagged", "is_changed")


def categories(layer: Column, blast: Column, coupled: Column, changed: Column, many: int = 10, some: int = 8) -> Column:
    """The rule categories of a chunk, sorted: the baseline, and others by risk and layer."""
    more = F.array(F.when(coupled | layer.isin("domain", "data"), "architecture"), F.when(blast >= many, "performance"), F.when(changed & (blast >= some), "testing"))
    return F.array_sort(F.concat(F.array(*map(F.lit, BASELINE)), F.filter(more, lambda x: x.isNotNull())))


def review_order(chunks: DataFrame, changed: DataFrame | None = None, least: int = 3) -> DataFrame:
    """chunk_id, tier, lines: changed functions first, then others and classes, then blocks; the longest first (`flow.queue` gives places).

    Without `changed` (node) every function counts as changed. Chunks of fewer than `least` lines or other types have no tier.
    """
    n = F.col("end_line") - F.col("start_line") + 1
    c = chunks.where(F.col("chunk_type").isin("function", "method", "class", "block") & (n >= least)).select("chunk_id", "chunk_type", n.alias("lines"))
    is_changed = F.lit(True)
    if changed is not None:
        c = c.join(changed.select(F.col("node").alias("chunk_id"), F.lit(True).alias("__c")), "chunk_id", "left")
        is_changed = F.coalesce("__c", F.lit(False))
    tier = F.when(F.col("chunk_type").isin("function", "method") & is_changed, 1).when(F.col("chunk_type") == "block", 3).otherwise(2)
    return c.select("chunk_id", tier.alias("tier"), "lines")


def top_dependencies(edges: DataFrame, most: int = 3) -> DataFrame:
    """src, dst, place: up to three direct dependencies of each node, itself left out, by confidence and id."""
    e = edges.where("src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.col("confidence").desc(), "dst"))).where(F.col("place") <= most).select("src", "dst", "place")


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """node, n_out, outgoing, n_in, incoming: all distinct neighbours in order, with their counts."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.array_sort(F.collect_list("dst")).alias("outgoing"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.array_sort(F.collect_list("src")).alias("incoming"))
    return out.join(into, "node", "full")


def overlapping(groups: DataFrame, chunks: DataFrame, file: list[str]) -> DataFrame:
    """file, line, chunk_id: the first chunk of a file that overlaps a group's lines (line to end_line)."""
    c = chunks.select(*file, F.col("start_line").alias("__s"), F.col("end_line").alias("__e"), "chunk_id")
    hit = groups.join(c, file).where((F.col("__s") <= F.col("end_line")) & (F.col("__e") >= F.col("line")))
    return hit.groupBy(*file, "line", "end_line").agg(F.min_by("chunk_id", F.struct("__s", "chunk_id")).alias("chunk_id"))


def enclosing(spans: DataFrame, file: list[str], key: str = "chunk_id") -> DataFrame:
    """key, outer: of each span the innermost other one that contains it, null if none does.

    Spans meet only within their file; an outer span starts no later and ends no earlier, and is longer.
    """
    o = spans.select(*file, F.col(key).alias("outer"), F.col("start_line").alias("__s"), F.col("end_line").alias("__e"))
    inside = (F.col("__s") <= F.col("start_line")) & (F.col("__e") >= F.col("end_line")) & (F.col("__e") - F.col("__s") > F.col("end_line") - F.col("start_line"))
    best = spans.join(o, file).where(inside).groupBy(key).agg(F.min_by("outer", F.struct(F.col("__e") - F.col("__s"), "outer")).alias("outer"))
    return spans.select(key).join(best, key, "left")


def long_parts(symbols: DataFrame, blanks: DataFrame, key: str = "chunk_id", longest: int = 150, overlap: int = 15, around: int = 10) -> DataFrame:
    """key, part, part_start, part_end: symbols over `longest` lines cut near blank lines.

    `symbols` has key, start_line, end_line; `blanks` key and lines (sorted numbers of blank lines). Each part ends at the last blank
    line within `around` lines of its limit, else at the limit; the next starts `overlap` lines earlier. The last ends with the symbol.
    """
    rows = symbols.where(F.col("end_line") - F.col("start_line") + 1 > longest).join(blanks.select(key, "lines"), key, "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<int>")))
    start = F.struct(F.col("start_line").cast("int").alias("at"), F.lit(False).alias("done"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        limit = s["at"] + longest - 1
        near = F.array_max(F.filter("lines", lambda b: (b >= limit - around) & (b <= limit) & (b > s["at"] + overlap)))
        end = F.least(F.coalesce(near, limit), F.col("end_line").cast("int"))
        last = limit >= F.col("end_line")
        b = F.when(last, F.col("end_line").cast("int")).otherwise(end)
        after = F.struct((b - overlap + 1).cast("int").alias("at"), last.alias("done"), F.concat(s["out"], F.array(F.struct(s["at"].alias("a"), b.alias("b")))).alias("out"))
        return F.when(s["done"], s).otherwise(after)

    rounds = F.sequence(F.lit(1), F.ceil((F.col("end_line") - F.col("start_line") + 1) / F.lit(longest - around - overlap)).cast("int") + 1)
    cut = rows.withColumn("out", F.aggregate(rounds, start, step)["out"])
    return cut.select(key, F.posexplode("out").alias("i", "p")).select(key, (F.col("i") + 1).alias("part"), F.col("p.a").alias("part_start"), F.col("p.b").alias("part_end"))


def reflected(issues: DataFrame, decisions: DataFrame, file: str = "file", least: int = 2) -> DataFrame:
    """Issues after a second look: files with `least` findings or a serious one follow the decisions (file, idx, keep, severity, seq), others stay.

    A finding without a decision stays; of several for one index the last by seq counts.
    """
    w = Window.partitionBy(file)
    serious = F.col("severity").isin("CRITICAL", "HIGH").cast("int")
    gated = issues.withColumn("__gate", (F.count("*").over(w) >= least) | (F.max(serious).over(w) > 0))
    last = decisions.groupBy(file, "idx").agg(F.max_by(F.struct("keep", F.col("severity").alias("s")), "seq").alias("__d"))
    j = gated.join(last, [file, "idx"], "left")
    keep = ~F.col("__gate") | F.coalesce("__d.keep", F.lit(True))
    changed = F.when(F.col("__gate"), F.coalesce("__d.s", "severity")).otherwise(F.col("severity"))
    return j.where(keep).withColumn("severity", changed).drop("__gate", "__d")


def with_defaults(raw: DataFrame) -> DataFrame:
    """Findings with what a reviewer left out: rule UNKNOWN, severity INFO, confidence 0.7, category general."""
    return raw.withColumns({"rule_id": F.coalesce("rule_id", F.lit("UNKNOWN")), "severity": severity(F.coalesce("severity", F.lit("INFO"))), "confidence": F.coalesce("confidence", F.lit(0.7)), "category": F.coalesce("category", F.lit("general"))})


def rendered(groups: DataFrame, platform: str = "markdown") -> DataFrame:
    """Adds body: a comment for a group (severity, title, description, suggestion), as markdown, html or text."""
    head, more = F.concat(F.lit("["), "severity", F.lit("] "), F.coalesce("title", F.lit(""))), F.coalesce("description", F.lit(""))
    hint = F.coalesce("suggestion", F.lit(""))
    if platform == "html":
        body = F.concat(F.lit("<b>"), html_escaped(head), F.lit("</b><p>"), html_escaped(more), F.lit("</p>"), F.when(hint != "", F.concat(F.lit("<pre>"), html_escaped(hint), F.lit("</pre>"))).otherwise(""))
    elif platform == "text":
        body = F.concat_ws("\n", head, F.when(more != "", more), F.when(hint != "", F.concat(F.lit("Suggestion: "), hint)))
    else:
        body = F.concat(F.lit("**"), head, F.lit("**"), F.when(more != "", F.concat(F.lit("\n\n"), more)).otherwise(""), F.when(hint != "", F.concat(F.lit("\n\n> "), F.replace(hint, F.lit("\n"), F.lit("\n> ")))).otherwise(""))
    return groups.withColumn("body", body)


def embed_text(language: Column, path: Column, symbol: Column, content: Column, most: int = 60) -> Column:
    """The text a chunk is embedded by: a line that says what it is, then its first lines."""
    return F.concat(F.lit("# "), F.concat_ws(" ", language, symbol, F.lit("in"), path), F.lit("\n"), head_lines(content, most))


def context(chunks: DataFrame, parents: DataFrame, dependencies: DataFrame, content: str = "content") -> DataFrame:
    """chunk_id, text: a chunk with its parent's first ten lines and up to three dependencies' first eight, in fixed order."""
    # only heads are joined: ten lines and eight
    text = F.coalesce(F.col(content), F.lit(""))
    body = chunks.select(F.col("chunk_id").alias("k"), F.col("symbol_name").alias("s"), head_lines(text, 10).alias("ten"), head_lines(text, 8).alias("eight"))
    own = chunks.select("chunk_id", F.concat(F.lit("## Code\n"), head_lines(F.coalesce(F.col(content), F.lit("")), 150)).alias("code"))
    up = parents.where("parent_id IS NOT NULL").join(body, F.col("parent_id") == F.col("k")).select("chunk_id", F.concat(F.lit("## Parent\n"), "ten").alias("parent"))
    deps = dependencies.join(body, F.col("dst") == F.col("k")).select(F.col("src").alias("chunk_id"), "place", F.concat(F.lit("## Uses "), F.coalesce("s", F.lit("")), F.lit("\n"), "eight").alias("t"))
    used = deps.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), "\n").alias("uses"))
    return own.join(up, "chunk_id", "left").join(used, "chunk_id", "left").select("chunk_id", F.concat_ws("\n", "parent", "uses", "code").alias("text"))
