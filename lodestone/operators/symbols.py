"""Symbol tables and priority-ranked resolution of calls, bases and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import domain, strip_generic

#: What may stand before a call's name and is left out when the plain name doesn't resolve.
RECEIVERS = r"^(?:self|cls|this\?|this|super\?|super|it)\."
#: Names before a bracket that are no calls.
NO_CALLS = (
    "if for while switch catch return def function func fun fn class with print len range str int float bool list dict set tuple isinstance super and or not in is elif except lambda await async new typeof sizeof guard when throw try else do void var val let const"
).split()
#: Extensions tried for a module.
MODULE_ENDS = ("", ".py", ".ts", ".js", ".dart", ".kt", ".swift", ".rs")


def bare(name: Column) -> Column:
    """A symbol's name without what qualifies it."""
    return F.regexp_extract(name, r"([^.:#/]+)$", 1)


def entries(chunks: DataFrame) -> DataFrame:
    """repo_name, file_path, name, parent, kind, chunk_id, start_line: one row per declared symbol."""
    kinds = ("function", "method", "class", "class_head", "constant")
    return chunks.where(F.col("chunk_type").isin(*kinds) & F.col("symbol_name").isNotNull()).select(
        "repo_name", "file_path", bare(F.col("symbol_name")).alias("name"), F.col("parent_symbol").alias("parent"), F.col("chunk_type").alias("kind"), "chunk_id", "start_line"
    )


def first_by(symbols: DataFrame, *keys: str) -> DataFrame:
    """Per key the first symbol: by file, start line, id. One row a key, so a lookup never multiplies rows, however common a name."""
    return symbols.groupBy(*keys).agg(F.min_by(F.struct("chunk_id", "file_path"), F.struct("file_path", "start_line", "chunk_id")).alias("hit"))


def calls(chunks: DataFrame) -> DataFrame:
    """chunk_id, repo_name, file_path, parent, callee: the distinct names a function or method calls."""
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_][\w.]*)\s*\("), 1))
    own = bare(F.col("symbol_name"))
    out = chunks.where(F.col("chunk_type").isin("function", "method") & F.col("content").isNotNull()).select("chunk_id", "repo_name", "file_path", F.col("parent_symbol").alias("parent"), own.alias("own"), F.explode(found).alias("callee"))
    return out.where(~F.col("callee").isin(*NO_CALLS) & ~F.col("callee").eqNullSafe(F.col("own"))).drop("own")


def resolve_calls(called: DataFrame, symbols: DataFrame) -> DataFrame:
    """chunk_id, callee, target, confidence, via: the best candidate of each call.

    In order: the caller's class in its file, the file (by name, or by class and name as in `Store.save`), the repository (1.0 in the
    file, else 0.8); a receiver such as `self.` is left out. What is called on another object stays external, with 0.5: its type
    isn't known. Each step is an equi-join with one row a key.
    """
    c = called.withColumn("name", F.regexp_replace(F.regexp_replace("callee", RECEIVERS, ""), r"^super\.", ""))
    in_class = first_by(symbols.where(F.col("parent").isNotNull()), "repo_name", "file_path", "parent", "name").withColumnRenamed("hit", "by_class")
    qualified = symbols.where(F.col("parent").isNotNull()).withColumn("name", F.concat_ws(".", "parent", "name"))
    in_file = first_by(symbols.unionByName(qualified), "repo_name", "file_path", "name").withColumnRenamed("hit", "by_file")
    in_repo = first_by(symbols, "repo_name", "name").withColumnRenamed("hit", "by_name")
    j = c.join(in_class, ["repo_name", "file_path", "parent", "name"], "left").join(in_file, ["repo_name", "file_path", "name"], "left").join(in_repo, ["repo_name", "name"], "left")
    hit = F.coalesce("by_class", "by_file", "by_name")
    via = F.when(F.col("by_class").isNotNull(), "class").when(F.col("by_file").isNotNull(), "file").when(F.col("by_name").isNotNull(), "name").otherwise("external")
    confidence = F.when(F.col("by_class").isNotNull() | F.col("by_file").isNotNull(), 1.0).when(F.col("by_name").isNotNull(), 0.8).otherwise(0.5)
    return j.select("chunk_id", "repo_name", "file_path", "callee", hit["chunk_id"].alias("target"), hit["file_path"].alias("target_file"), confidence.alias("confidence"), via.alias("via"))


def resolve_bases(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """chunk_id, base, target: the bases of each class that a class of the repository declares; others are dropped."""
    text = F.array_join(F.slice(F.split("content", r"\r\n|\n|\r"), 1, 3), " ")
    listed = F.coalesce(F.nullif(F.regexp_extract(text, r"class\s+\w+\s*\(([^)]*)\)", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?:extends|implements|class\s+\w+[^:{]*:)\s+([^{]*)", 1), F.lit("")))
    heads = chunks.where(F.col("chunk_type").isin("class", "class_head") & F.col("content").isNotNull())
    named = heads.select("chunk_id", "repo_name", F.explode(F.split(F.coalesce(listed, F.lit("")), r"\s*(?:,|\bimplements\b|\bwith\b)\s*")).alias("raw")).select("chunk_id", "repo_name", strip_generic(F.col("raw")).alias("base")).where("base <> ''").distinct()
    known = first_by(symbols.where(F.col("kind").isin("class", "class_head")), "repo_name", "name").withColumnRenamed("name", "base")
    return named.join(known, ["repo_name", "base"]).select("chunk_id", "base", F.col("hit.chunk_id").alias("target"))


def module_candidates(path: Column, importer: Column) -> Column:
    """Paths a module may have, best first: as it is, relative to the importer, dots as slashes with each extension, each also below src/."""
    folder = F.regexp_replace(importer, r"[^/]*$", "")
    slashed = F.when(path.contains("/"), path).otherwise(F.replace(path, F.lit("."), F.lit("/")))
    relative = F.concat(folder, F.regexp_replace(path, r"^\./", ""))
    ends = [F.concat(x, F.lit(e)) for x in (relative, slashed, F.concat(F.lit("src/"), slashed)) for e in MODULE_ENDS]
    return F.array(path, *ends)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """chunk_id, module, target (null if external): the file that a module names, by its best candidate."""
    tried = imports.select("chunk_id", "repo_name", "module", F.posexplode(module_candidates(F.col("module"), F.col("file_path"))).alias("rank", "path"))
    found = tried.join(files.select("repo_name", "path").distinct(), ["repo_name", "path"]).groupBy("chunk_id", "module").agg(F.min_by("path", "rank").alias("target"))
    return imports.select("chunk_id", "module").distinct().join(found, ["chunk_id", "module"], "left")


def cross_domain(a: Column, b: Column) -> Column:
    """Whether two paths lie in different top folders; never if either has none."""
    return F.coalesce(domain(a) != domain(b), F.lit(False))
