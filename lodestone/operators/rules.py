"""Mechanical rules: chunk to violations, each an expression over the chunk's lines."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import lines

#: What a rule's line patterns look for.
SECRET = r"(?i)(?:password|passwd|secret|api[_-]?key|auth[_-]?token|access[_-]?token|private[_-]?key|client[_-]?secret|bearer)\s*=\s*['\"]([^'\"]{4,})['\"]"
PLACEHOLDER = r"(?i)^(?:dummy\w*|changeme|x{3,}|placeholder\w*|fake\w*|example\w*|test\w*|your[_-].*here|\.{3,}|<[^>]*>)$"
TEST_PATH = r"(?i)(?:^|/)(?:tests?|specs?|mocks?|fixtures?|__tests__|__mocks__)(?:/|$)"
MAGIC_SKIP = r"(?:def |class |import |from |#|\"\"\"|'''|const |CONSTANT|_MAX|_MIN|_DEFAULT|_SIZE|_LIMIT|=\s*\d+\s*$)"
MAGIC_CONTEXT = r"<=|>=|==|!=|<|>|\bfor\b|\bwhile\b|\brange\("
#: A number of 3 or more with no word character, dot or minus before it and no word character after.
MAGIC = r"(?:^|[^\p{L}\p{N}_.\-])(?:[2-9]\d{2,}|[1-9]\d+|[3-9])(?:$|[^\p{L}\p{N}_])"
NETWORK = r"URLSession\s*\.|URLRequest\s*\(|\.dataTask\s*\(|\.uploadTask\s*\(|\.downloadTask\s*\(|Alamofire\s*\.|\bAF\s*\.request\s*\(|\bAF\s*\.upload\s*\(|\bAF\s*\.download\s*\("
HINTED = r"(?m)^\s*(?:async\s+)?def\s+\w+\s*\(([^)]*)\)\s*(?:->|:)"
RECEIVERS = ("self", "cls", "&self", "&mut self", "mut self")
FUNCTIONS = ("function", "method")


class Rule(NamedTuple):
    """`hits` gives, from a chunk's columns (ls: its lines), the indexes (0: the chunk itself) where the rule is broken."""

    rule_id: str
    severity: str
    hits: Callable[[], Column]


def _where(test: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform("ls", lambda x, i: F.when(test(x), i + 1)), lambda i: i.isNotNull())


def _whole(condition: Column) -> Column:
    return F.when(condition, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))


def _only(condition: Column, hits: Column) -> Column:
    return F.when(condition, hits).otherwise(F.array().cast("array<int>"))


def _function() -> Column:
    return F.col("chunk_type").isin(*FUNCTIONS)


def code_lines() -> Column:
    return F.size(F.filter("ls", lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(?:#|//)")))


def parameters() -> Column:
    """How many parameters a signature in the first 15 lines has: top-level commas plus one, a receiver left out."""
    text = F.array_join(F.slice("ls", 1, 15), "\n")
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(False).alias("open"), F.lit(False).alias("done"), F.lit("").alias("first"))

    def step(s: Column, ch: Column) -> Column:
        top = s["p"] == 1
        begins = (ch == "(") & (s["p"] == 0)
        ends = (ch == ")") & top & s["open"]
        flat = top & (s["a"] == 0) & (s["b"] == 0)
        comma = (ch == ",") & flat
        after = F.struct(
            (s["p"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)).alias("p"),
            (s["a"] + F.when(top & (ch == "<"), 1).when(top & (ch == ">") & (s["a"] > 0), -1).otherwise(0)).alias("a"),
            (s["b"] + F.when(top & (ch == "["), 1).when(top & (ch == "]") & (s["b"] > 0), -1).otherwise(0)).alias("b"),
            (s["n"] + comma.cast("int")).alias("n"),
            (s["open"] | begins).alias("open"),
            ends.alias("done"),
            F.when(s["open"] & ~begins & (s["n"] == 0) & ~((ch == ",") & top) & ~ends, F.concat(s["first"], ch)).otherwise(s["first"]).alias("first"),
        )
        return F.when(s["done"], s).otherwise(after)

    # runs of other characters pass as one step
    end = F.aggregate(F.regexp_extract_all(text, F.lit(r"([(),<>\[\]]|[^(),<>\[\]]+)"), 1), start, step)
    first = F.trim(F.regexp_replace(end["first"], r"\s+", " "))
    return F.when(end["open"], end["n"] + 1 - first.isin(*RECEIVERS).cast("int")).otherwise(0)


def commas() -> Column:
    """How many commas the first 15 lines have: as many as there are parameters less one, at least."""
    text = F.array_join(F.slice("ls", 1, 15), "\n")
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))


def _mounted() -> Column:
    """First use of context after each await that no check of mounted precedes."""
    start = F.struct(F.lit(False).alias("awaited"), F.lit(False).alias("checked"), F.array().cast("array<int>").alias("hits"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        t = F.trim(x)
        idle = (t == "") | t.startswith("//")
        waits, mounts, uses = (t.rlike(rf"\b{w}\b") for w in ("await", "mounted", "context"))
        hit = ~idle & ~waits & s["awaited"] & ~mounts & uses & ~s["checked"]
        return F.struct(
            F.when(~idle & waits, True).when(hit, False).otherwise(s["awaited"]).alias("awaited"),
            F.when(~idle & waits, False).when(~idle & s["awaited"] & mounts, True).otherwise(s["checked"]).alias("checked"),
            F.when(hit, F.concat(s["hits"], F.array(s["i"] + 1))).otherwise(s["hits"]).alias("hits"),
            (s["i"] + 1).alias("i"),
        )

    return F.aggregate("ls", start, step)["hits"]


def _unhinted() -> Column:
    head = F.array_join(F.slice("ls", 1, 8), "\n")
    found = head.rlike(HINTED)
    names = F.filter(F.transform(F.split(F.regexp_extract(head, HINTED, 1), ","), F.trim), lambda p: ~p.isin("self", "cls", ""))
    bare = F.exists(names, lambda p: ~F.split(p, "=")[0].contains(":"))
    return found & (bare | ~head.contains("->"))


RULES = (
    Rule("GEN001", "MEDIUM", lambda: _whole(_function() & (F.size("ls") > 50) & (code_lines() > 50))),
    Rule("SEC001", "CRITICAL", lambda: _only(F.col("content").rlike(SECRET) & ~F.coalesce(F.col("file_path").rlike(TEST_PATH), F.lit(False)), _where(lambda x: x.rlike(SECRET) & ~F.trim(F.regexp_extract(x, SECRET, 1)).rlike(PLACEHOLDER)))),
    Rule("GEN002", "LOW", lambda: F.slice(_only(_function(), _where(lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#") & ~F.trim(x).rlike(MAGIC_SKIP) & F.trim(x).rlike(MAGIC_CONTEXT) & F.trim(x).rlike(MAGIC))), 1, 3)),
    Rule("CP013", "MEDIUM", lambda: _whole(F.when(_function() & (commas() >= 5), parameters() > 5).otherwise(False))),
    Rule("SW008", "HIGH", lambda: F.slice(_only(_function() & (F.col("language") == "swift") & (F.coalesce("parent_symbol", F.lit("")).contains("ViewController") | F.coalesce("file_path", F.lit("")).contains("ViewController")), _where(lambda x: ~F.trim(x).startswith("//") & x.rlike(NETWORK))), 1, 3)),
    Rule("DA008", "HIGH", lambda: F.slice(_only(_function() & (F.col("language") == "dart"), _mounted()), 1, 3)),
    Rule("PY001", "LOW", lambda: _whole(_function() & (F.col("language") == "python") & ~F.coalesce("symbol_name", F.lit("")).startswith("_") & _unhinted())),
)


def violations(chunks: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """chunk_id, rule_id, severity, line: all violations; modules and imports are never looked at.

    Lines count from start_line (null counts as 1), by content without any location header. Null content breaks no rule. A rule is an expression,
    so one pass over the texts judges all of them.
    """
    judged = chunks.where(F.col("content").isNotNull() & ~F.col("chunk_type").isin("module", "import")).withColumn("ls", lines(F.col("content")))
    every = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.coalesce(r.hits(), F.array().cast("array<int>")).alias("at")) for r in rules))
    one = judged.select("chunk_id", F.coalesce("start_line", F.lit(1)).alias("start_line"), F.explode(every).alias("r"))
    return one.select("chunk_id", "r.rule_id", "r.severity", "start_line", F.explode("r.at").alias("i")).select("chunk_id", "rule_id", "severity", (F.col("start_line") + F.col("i") - 1).alias("line"))


def god_classes(chunks: DataFrame, most: int = 10) -> DataFrame:
    """parent_symbol, methods of the classes (by repository and name) with more than `most` public methods of their own."""
    head = F.array_join(F.slice(lines(F.col("content")), 1, 3), "\n")
    own = ~head.rlike(r"\boverride\b|@[Oo]verride\b|\bprivate\b|\bfileprivate\b") & ~F.coalesce("symbol_name", F.lit("")).rlike(r"(^|\.)_") & ((F.col("language") != "rust") | head.rlike(r"\bpub\b"))
    m = chunks.where((F.col("chunk_type") == "method") & F.col("content").isNotNull() & F.col("parent_symbol").isNotNull() & own & ~F.lower("parent_symbol").contains("test"))
    # re-delivered chunks count once; only ids and names are shuffled
    return m.select("repo_name", "parent_symbol", "chunk_id").distinct().groupBy("repo_name", "parent_symbol").agg(F.count("*").alias("methods")).where(F.col("methods") > most)
