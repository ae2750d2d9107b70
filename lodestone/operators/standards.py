"""Coding standards as a table: markdown to rules, and which rules apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import category, lines, severity, severity_rank


#: The lines of the format that mean something: a rule's heading, a section's, a field, and where examples begin.
RULE_HEADING = r"^###\s+([A-Z]{2,6}\d{3,4})\s+[—\-]+\s+(.+)$"
SECTION_HEADING = r"^##\s+(.+)$"
FIELD = r"^\s*-\s+\*\*(\w[\w\s]*?)\*\*:\s*(.+)$"
EXAMPLE_OF = r"(?i)^\s*-\s+\*\*{}[:*]*\*\*:?\s*(.*)"


def rules(texts: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """rule_id, language, category, severity, title, description, bad_example, good_example of each `### ID — title` in markdown.

    The category is the rule's own, else its `##` section's. All lines are numbered and headings carried forward by
    window functions within a document; documents are small and independent.
    """
    w = Window.partitionBy(name).orderBy("no")
    l = texts.select(name, F.posexplode(lines(F.col(text))).alias("no", "line"))  # noqa: E741
    heading = RULE_HEADING
    section = F.when(F.col("line").rlike(SECTION_HEADING), category(F.regexp_extract("line", SECTION_HEADING, 1)))
    l = l.withColumns({"section": F.last(section, ignorenulls=True).over(w), "rule_no": F.sum(F.col("line").rlike(heading).cast("int")).over(w), "head": F.col("line").rlike(r"^###?\s")})  # noqa: E741
    # a section heading ends a rule
    l = l.withColumn("block", F.sum((F.col("line").rlike(heading) | section.isNotNull()).cast("int")).over(w))  # noqa: E741
    b = Window.partitionBy(name, "block").orderBy("no")
    l = l.withColumn("title_line", F.first("line").over(b)).where(F.col("title_line").rlike(heading))  # noqa: E741
    meta = lambda k: F.max(F.when(F.lower(F.regexp_extract("line", FIELD, 1)) == k, F.regexp_extract("line", FIELD, 2)))
    mark = EXAMPLE_OF.format
    mode = F.last(F.when(F.col("line").rlike(mark("Good")), "good").when(F.col("line").rlike(mark("Bad")), "bad"), ignorenulls=True).over(b)
    l = l.withColumn("mode", F.coalesce(mode, F.lit("desc"))).withColumn("body", F.regexp_replace(F.regexp_replace("line", mark("Good"), "$1"), mark("Bad"), "$1"))  # noqa: E741
    plain = ~F.col("line").rlike(r"^###\s") & ~F.lower(F.regexp_extract("line", FIELD, 1)).isin("severity", "language", "category")
    part = lambda m: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(plain & (F.col("mode") == m), F.struct("no", "body")))), lambda x: x["body"]), "\n"))
    g = l.groupBy(name, "block").agg(F.first("title_line").alias("t"), F.max("section").alias("section"), meta("severity").alias("sev"), meta("language").alias("lang"), meta("category").alias("cat"), part("desc").alias("description"), part("bad").alias("bad_example"), part("good").alias("good_example"))
    return g.select(
        F.regexp_extract("t", heading, 1).alias("rule_id"), F.lower(F.trim(F.coalesce("lang", F.lit("all")))).alias("language"), F.lower(F.trim(F.coalesce("cat", "section", F.lit("general")))).alias("category"),
        severity(F.coalesce("sev", F.lit(""))).alias("severity"), F.trim(F.regexp_extract("t", heading, 2)).alias("title"), "description", "bad_example", "good_example",
    )


def for_languages(table: DataFrame, languages: DataFrame, most: int = 30, categories: DataFrame | None = None) -> DataFrame:
    """The rules of each language and those of all, with language and rank: most severe first, at most `most` of them.

    With categories (language, category) only rules of a language's categories apply. The two cases are two equi-joins, so no pair
    is tried that doesn't apply.
    """
    own = languages.join(table.withColumnRenamed("language", "l"), F.col("language") == F.col("l")).drop("l")
    every = languages.withColumn("l", F.lit("all")).join(table.withColumnRenamed("language", "l"), "l").drop("l")
    both = own.unionByName(every)
    if categories is not None:
        both = both.join(categories.select("language", "category").distinct(), ["language", "category"], "left_semi")
    w = Window.partitionBy("language").orderBy(severity_rank(F.col("severity")), "rule_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def by_severity(table: DataFrame, *names: str) -> DataFrame:
    return table.where(F.col("severity").isin(*names))


def by_category(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("category") == name.lower())


def grave(table: DataFrame) -> DataFrame:
    """Rules of severity CRITICAL or HIGH."""
    return by_severity(table, "CRITICAL", "HIGH")


def counts(table: DataFrame) -> DataFrame:
    """language, rules, critical: how many rules each language has."""
    return table.groupBy("language").agg(F.count("*").alias("rules"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))


def read(spark: SparkSession, folder: str, single: str | None = None) -> DataFrame:
    """The rules of all markdown files right in a folder; where it has none, those of one file; where that is missing too, none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*.md")
    found = path.getFileSystem(conf).globStatus(path)
    if found is not None and len(found):
        source = path.toString()
    elif single and (one := jvm.org.apache.hadoop.fs.Path(single)).getFileSystem(conf).exists(one):
        source = single
    else:
        return rules(spark.createDataFrame([], "name string, text string"))
    texts = spark.read.text(source, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("text"))
    return rules(texts)


def blocks(applying: DataFrame) -> DataFrame:
    """language, text: the rules that apply (see for_languages) as one block for a prompt, in order of rank.

    Of a description 200 characters, of examples three lines, and those only from HIGH on. A language has as many rules as `for_languages` lets through.
    """
    loud = F.col("severity").isin("CRITICAL", "HIGH")
    example = lambda c, k: F.when(loud & (F.trim(F.col(c)) != ""), F.concat(F.lit(f"\n  {k}"), F.array_join(F.slice(lines(F.trim(F.col(c))), 1, 3), "\n")))
    said = F.when(F.col("description") != "", F.concat(F.lit("\n  → "), F.substring("description", 1, 200)))
    one = F.concat(F.lit("["), "rule_id", F.lit("] ["), "severity", F.lit("] "), "title", *(F.coalesce(x, F.lit("")) for x in (said, example("bad_example", "BAD:  "), example("good_example", "GOOD: "))))
    g = applying.select("language", "rank", one.alias("one")).groupBy("language").agg(F.array_sort(F.collect_list(F.struct("rank", "one"))).alias("r"))
    head = F.concat(F.lit("CODING STANDARDS ("), F.size("r").cast("string"), F.lit(" rules, language="), "language", F.lit("):\n"))
    return g.select("language", F.concat(head, F.array_join(F.transform("r", lambda x: x["one"]), "\n")).alias("text"))
