"""Files to chunks: windows, gaps, parts of long symbols, neighbours and parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import lines


def windows(files: DataFrame, size: int = 60, stride: int = 45, content: str = "content") -> DataFrame:
    """The files' other columns with start_line, end_line, text of their sliding windows; blank ones are dropped, short last ones stay."""
    starts = F.sequence(F.lit(1), F.size("__ls"), F.lit(stride))
    window = lambda at: F.struct(at.alias("start_line"), F.least(at + size - 1, F.size("__ls")).alias("end_line"), F.array_join(F.slice("__ls", at, F.lit(size)), "\n").alias("text"))
    cut = files.where(F.col(content).isNotNull()).withColumn("__ls", lines(F.col(content))).where(F.size("__ls") > 0)
    # windows are cut before rows are multiplied: a row holds its own lines only
    rest = [c for c in files.columns if c != content]
    out = cut.select(*rest, F.explode(F.transform(starts, window)).alias("__w")).select(*rest, "__w.*")
    return out.where(F.trim(F.regexp_replace("text", r"\s+", "")) != "")


def sentence_offsets(n: Column, step: int = 5) -> Column:
    """0, 5, 10 ... and the number of lines."""
    base = F.sequence(F.lit(0), n - 1, F.lit(step))
    return F.when(n <= 0, F.array(F.lit(0))).otherwise(F.concat(base, F.array(n)))


def parts(symbols: DataFrame, longest: int = 100, overlap: int = 15) -> DataFrame:
    """part, part_start, part_end of every symbol (start_line, end_line) over `longest` lines, in closed form."""
    n, stride = F.col("end_line") - F.col("start_line") + 1, longest - overlap
    long = symbols.where(n > longest).withColumn("part", F.explode(F.sequence(F.lit(1), F.ceil((n - overlap) / stride).cast("int"))))
    begin = F.col("start_line") + (F.col("part") - 1) * stride
    label = F.ceil(n / stride).cast("int")
    return long.withColumns({"part_start": begin, "part_end": F.least(begin + longest - 1, F.col("end_line")), "label": F.concat(F.lit("@split:"), F.col("part").cast("string"), F.lit("/"), label.cast("string"))})


def neighbours(chunks: DataFrame, file: list[str], order: list[str], key: str = "chunk_id") -> DataFrame:
    """Adds prev_id and next_id within a file."""
    w = Window.partitionBy(*file).orderBy(*order)
    return chunks.withColumns({"prev_id": F.lag(key).over(w), "next_id": F.lead(key).over(w)})


def parents(chunks: DataFrame, file: list[str]) -> DataFrame:
    """chunk_id, parent_id of each method: the first class head of its parent's name in its file."""
    heads = chunks.where(F.col("chunk_type") == "class_head").groupBy(*file, F.col("symbol_name").alias("parent_symbol")).agg(F.min_by("chunk_id", F.struct("start_line", "chunk_id")).alias("parent_id"))
    return chunks.where(F.col("chunk_type") == "method").join(heads, [*file, "parent_symbol"], "left").select("chunk_id", "parent_id")


def islands(spans: DataFrame, key: list[str]) -> DataFrame:
    """key, start_line, end_line: overlapping or adjoining spans of a key merged."""
    w = Window.partitionBy(*key).orderBy("start_line", "end_line")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", (before.isNull() | (F.col("start_line") > before + 1)).cast("int")).withColumn("__island", F.sum("__new").over(w))
    return marked.groupBy(*key, "__island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("__island")


def gaps(spans: DataFrame, sizes: DataFrame, key: list[str], least: int = 20) -> DataFrame:
    """key, start_line, end_line of the uncovered runs of `least` lines or more; `sizes` has key and n (lines).

    A file without spans is one gap. Spans beyond the file are cut at its end.
    """
    # a file's end is one more span, right behind its last line: then every gap lies before a span, and one pass finds all
    ends = sizes.select(*key, (F.col("n") + 1).alias("start_line"), (F.col("n") + 1).alias("end_line"), "n")
    rows = spans.select(*key, "start_line", "end_line", F.lit(None).cast("int").alias("n")).unionByName(ends)
    before = Window.partitionBy(*key).orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    free = rows.withColumns({"a": F.coalesce(F.max("end_line").over(before), F.lit(0)) + 1, "n": F.max("n").over(Window.partitionBy(*key))})
    out = free.withColumn("b", F.least(F.col("start_line") - 1, F.col("n"))).where(F.col("n").isNotNull() & (F.col("b") - F.col("a") + 1 >= least))
    return out.select(*key, F.col("a").alias("start_line"), F.col("b").alias("end_line"))


#: How lines begin that belong to a module's preamble.
PREAMBLE = r"^\s*(?:import|from|use\s|#|//|/\*|\*|package\s|@file|library\s|part\s)"


def module_end(content: Column, most: int = 50) -> Column:
    """Where a module's preamble ends: with the line after its first line of code, within the first 50 lines."""
    head = F.slice(lines(content), 1, most)
    code = F.array_position(F.transform(head, lambda x: (F.trim(x) != "") & ~x.rlike(PREAMBLE)), F.lit(True))
    return F.when(code > 0, F.least(code + 1, F.size(head).cast("bigint"))).otherwise(F.size(head).cast("bigint"))
