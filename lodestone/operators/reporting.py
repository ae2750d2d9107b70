"""Comments and reports: rendering for platforms, summaries, the order of comments, report rows and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import html_escaped, lines, severity_rank

#: Signs, call-outs and colours of severities.
SIGNS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🔵", "INFO": "⚪"}
CALLOUTS = {"CRITICAL": "CAUTION", "HIGH": "WARNING", "MEDIUM": "NOTE", "LOW": "NOTE", "INFO": "TIP"}
COLOURS = {"CRITICAL": "red", "HIGH": "orange", "MEDIUM": "yellow", "LOW": "blue", "INFO": "gray"}
PLATFORMS = ("github", "gitlab", "jira", "text")
#: How many characters of a line a short form shows.
SHORT = 120


def _of(table: dict[str, str], c: Column, other: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c], F.lit(other))


def with_issues(issues: DataFrame, key: list[str]) -> DataFrame:
    """key, severity (the gravest), list: a group's issues by severity, line and rule (rule_id, severity, title, description, suggestion, file_path, start_line)."""
    item = F.struct(severity_rank(F.col("severity")).alias("rank"), "start_line", "rule_id", "severity", F.coalesce("title", F.lit("")).alias("title"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), F.trim(F.coalesce("suggestion", F.lit(""))).alias("suggestion"), "file_path")
    return issues.groupBy(*key).agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.array_sort(F.collect_list(item)).alias("list"))


def _first(c: Column) -> Column:
    return F.substring(F.coalesce(F.try_element_at(lines(c), F.lit(1)), F.lit("")), 1, SHORT)


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def _present(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def rendered(groups: DataFrame, platform: str, signature: str = "") -> DataFrame:
    """Adds body: the comment of a group (see with_issues) for 'github', 'gitlab', 'jira' or 'text'. The signature names the rules after it."""
    rules = F.array_join(F.transform("list", lambda x: x["rule_id"]), ", ")
    signed = F.concat(F.lit(signature + " · ") if signature else F.lit(""), rules)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    when = lambda c, text: F.when(c != "", text)
    if platform == "github":
        opening = say("> [!", _of(CALLOUTS, F.col("severity"), "NOTE"), "]\n> ")
        head = lambda x: say(_of(SIGNS, x["severity"], ""), " **", x["title"], "** `", x["rule_id"], "` · ")
        x = F.col("list")[0]
        one = _present(say(opening, head(x), x["severity"]), when(x["description"], _joined(F.transform(lines(x["description"]), lambda s: say("> ", s)))), when(x["suggestion"], say(">\n> **Suggestion:** ", x["suggestion"])))
        item = lambda x: _joined(_present(say(">\n> ", head(x), "line ", x["start_line"].cast("string"), " · ", x["severity"]), when(x["description"], say(">   ", _first(x["description"]))), when(x["suggestion"], say(">   _Fix:_ ", _first(x["suggestion"])))))
        many = F.concat(F.array(say(opening, "**", F.size("list").cast("string"), " issues** in this area (dominant: ", F.col("severity"), ")")), F.transform("list", item))
        body = say(_joined(F.when(F.size("list") == 1, one).otherwise(many)), "\n\n<sub>", signed, "</sub>")
    elif platform == "gitlab":
        item = lambda x: _joined(_present(say("**", _of(SIGNS, x["severity"], ""), " ", x["title"], "** (`", x["rule_id"], "`) — *", x["severity"], "* at line ", x["start_line"].cast("string")), when(x["description"], say("\n", x["description"])), when(x["suggestion"], say("\n**Suggestion:** ", x["suggestion"])), F.lit("\n---")))
        body = say(_joined(F.transform("list", item)), "\n\n_", signed, "_")
    elif platform == "jira":
        item = lambda x: _joined(_present(say("h4. {", _of(COLOURS, x["severity"], "gray"), "|", x["severity"], "} ", x["title"], " (", x["rule_id"], ") — line ", x["start_line"].cast("string")), when(x["description"], x["description"]), when(x["suggestion"], say("*Suggestion:* ", x["suggestion"])), F.lit("")))
        body = say(_joined(F.transform("list", item)), "\n_", signed, "_")
    elif platform == "text":
        rule = "─" * 60
        item = lambda x: _joined(_present(say("[", x["severity"], "] ", x["rule_id"], ": ", x["title"], " (line ", x["start_line"].cast("string"), ")"), when(x["description"], wrapped(x["description"])), when(x["suggestion"], say("  Fix: ", x["suggestion"])), F.lit("")))
        body = say(rule, "\n", _joined(F.transform("list", item)), "\n", rule)
    else:
        raise ValueError(f"{platform} is none of {', '.join(PLATFORMS)}")
    return groups.withColumn("body", body)


def wrapped(text: Column, width: int = 72, indent: str = "  ") -> Column:
    """A text's words in lines of at most `width` characters, indented; a longer word has a line of its own."""
    words = F.filter(F.split(F.regexp_replace(text, r"\s+", " "), " "), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def step(s: Column, w: Column) -> Column:
        fits = (s["line"] == "") | (F.length(s["line"]) + 1 + F.length(w) + len(indent) <= width)
        grown = F.when(s["line"] == "", w).otherwise(F.concat(s["line"], F.lit(" "), w))
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.lit(indent), s["line"], F.lit("\n"))).alias("done"), F.when(fits, grown).otherwise(w).alias("line"))

    return F.aggregate(words, start, step, lambda s: F.when(s["line"] == "", "").otherwise(F.concat(s["done"], F.lit(indent), s["line"])))


def summaries(issues: DataFrame, by: list[str], inline: DataFrame, platform: str) -> DataFrame:
    """by, severity, body: the comment on issues that aren't shown inline; inline has by and n, the number of comments that are.

    One comment a review names all its issues, so its text grows with them: `by` should name a review, not a corpus.
    """
    g = with_issues(issues, by).join(inline, by, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("string"))
    count = F.size("list").cast("string")
    where = lambda x: F.concat(x["file_path"].cast("string"), F.lit(":"), x["start_line"].cast("string"))
    if platform == "github":
        head = F.concat(F.lit("> [!NOTE]\n> **Additional findings** ("), count, F.lit(" issues not shown inline)\n> "), "n", F.lit(" issue(s) already shown as inline comments.\n>"))
        item = lambda x: F.concat(F.lit("> "), _of(SIGNS, x["severity"], ""), F.lit(" `"), x["rule_id"], F.lit("` **"), x["title"], F.lit("** — "), where(x), F.lit(" · "), x["severity"])
    elif platform == "jira":
        head = F.concat(F.lit("h3. Additional findings ("), count, F.lit(" issues)\n"), "n", F.lit(" issue(s) already added as inline comments.\n"))
        item = lambda x: F.concat(F.lit("* ["), x["severity"], F.lit("] "), x["rule_id"], F.lit(": "), x["title"], F.lit(" — "), where(x))
    else:
        head = F.concat(F.lit("=== Additional findings ("), count, F.lit(" issues) ===\n"), "n", F.lit(" issue(s) already shown inline.\n"))
        item = lambda x: F.concat(F.lit("  ["), x["severity"], F.lit("] "), x["rule_id"], F.lit(": "), x["title"], F.lit(" ("), where(x), F.lit(")"))
    return g.select(*by, "severity", F.concat(head, F.lit("\n"), _joined(F.transform("list", item))).alias("body"))


def assembled(inline: DataFrame, summary: DataFrame) -> DataFrame:
    """kind, file_path, line, end_line, severity, body of all comments, inline ones by file and line first, then summaries (no file, line 0)."""
    a = inline.select(F.lit("inline").alias("kind"), F.col("file_path").cast("string").alias("file_path"), "line", "end_line", "severity", "body")
    b = summary.select(F.lit("summary").alias("kind"), F.lit("").alias("file_path"), F.lit(0).alias("line"), F.lit(0).alias("end_line"), "severity", "body")
    return a.unionByName(b).orderBy(F.col("kind") != "inline", "file_path", "line", "end_line")


def anchored(comments: DataFrame) -> DataFrame:
    """kind, file_path, line, payload: inline comments on a line as what a review's interface takes; others belong into its body."""
    several = F.col("end_line") > F.col("line")
    right = F.lit("RIGHT")
    at = F.struct(F.col("file_path").alias("path"), "body", F.when(several, F.col("line")).alias("start_line"), F.when(several, F.col("end_line")).otherwise(F.col("line")).alias("line"), right.alias("side"), F.when(several, right).alias("start_side"))
    return comments.where((F.col("kind") == "inline") & (F.col("line") > 0)).select("kind", "file_path", "line", F.to_json(at).alias("payload"))


def counts(issues: DataFrame, *by: str) -> DataFrame:
    """by, issues, files and the issues of each severity."""
    return issues.groupBy(*by).agg(F.count("*").alias("issues"), F.count_distinct("file_path").alias("files"), *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SIGNS))


def top_rules(issues: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """by, rule_id, n, place: the most frequent rules of each `by`; ties by name. Issues are counted before they are ranked."""
    n = issues.groupBy(*by, "rule_id").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "rule_id"))).where(F.col("place") <= most)


def review_bodies(issues: DataFrame, by: list[str], title: Column, most: int = 5) -> DataFrame:
    """by, body: the text above a review's comments: how many issues of which severity, and the most frequent rules."""
    c = counts(issues, *by)
    badges = F.concat_ws(" · ", *(F.when(F.col(s.lower()) > 0, F.concat(F.lit(f"**{s}**: "), F.col(s.lower()).cast("string"))) for s in list(SIGNS)[:4]))
    listed = top_rules(issues, by, most).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "rule_id", "n"))), lambda x: F.concat(F.lit("- `"), x["rule_id"], F.lit("` × "), x["n"].cast("string"))), "\n").alias("rules"))
    total = F.concat(F.lit("**"), F.col("issues").cast("string"), F.lit(" issue(s) found**"), F.when(badges != "", F.concat(F.lit(" · "), badges)).otherwise(""))
    note = F.lit("_Inline comments show specific violations. See the full HTML report for details._")
    return c.join(listed, by).select(*by, F.concat_ws("\n", title, F.lit(""), total, F.lit(""), F.lit("**Most frequent violations:**"), "rules", F.lit(""), note).alias("body"))


def file_reports(issues: DataFrame, by: list[str]) -> DataFrame:
    """by, file_path, report: one JSON row per file with its issues in order; a report is these rows under the counts of its `by`."""
    item = F.struct(severity_rank(F.col("severity")).alias("rank"), "start_line", "end_line", "rule_id", "severity", "title", "category")
    g = issues.groupBy(*by, "file_path").agg(F.count("*").alias("issue_count"), F.array_sort(F.collect_list(item)).alias("issues"))
    return g.select(*by, "file_path", F.to_json(F.struct(F.col("file_path").alias("path"), "issue_count", F.transform("issues", lambda x: x.dropFields("rank")).alias("issues"))).alias("report"))


def bar(n: Column, most: int = 30, each: int = 2) -> Column:
    """A bar of blocks, `each` per item and at most `most`."""
    return F.repeat(F.lit("█"), F.least(F.lit(most), n * each).cast("int"))


def share(n: Column, greatest: Column) -> Column:
    """n as whole percent of the greatest, 0 if there is none."""
    return F.when(greatest > 0, F.floor(100 * n / greatest)).otherwise(0).cast("int")


def console(issues: DataFrame, by: list[str]) -> DataFrame:
    """by, text: a review's counts by severity with bars, for a terminal."""
    c = counts(issues, *by)
    row = lambda s: F.when(F.col(s.lower()) > 0, F.concat(F.rpad(F.lit(s), 9, " "), F.lit(" "), F.rpad(bar(F.col(s.lower())), 30, " "), F.lit("  "), F.lpad(F.col(s.lower()).cast("string"), 4, " "), F.lit(" issue(s)")))
    return c.select(*by, F.concat_ws("\n", *(row(s) for s in SIGNS)).alias("text"))


def page(summary: DataFrame, files: DataFrame, title: str) -> str:
    """An HTML page of one review: its counts (one row of `counts`) and its files (file_path, issues, worst). Both are one review's, and small."""
    head = summary.first()
    rows = files.select(html_escaped(F.col("file_path").cast("string")).alias("f"), "issues", html_escaped(F.col("worst")).alias("w")).orderBy("file_path").toLocalIterator()
    cells = "".join(f"<tr><td>{r['f']}</td><td>{r['issues']}</td><td class='{r['w'].lower()}'>{r['w']}</td></tr>" for r in rows)
    tiles = "".join(f"<li class='{s.lower()}'>{s}: {head[s.lower()] if head else 0}</li>" for s in SIGNS)
    safe = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{safe}</title></head><body><h1>{safe}</h1><ul>{tiles}</ul><table><tr><th>File</th><th>Issues</th><th>Worst</th></tr>{cells}</table></body></html>"
