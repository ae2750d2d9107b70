"""Event logs and ledgers: rolling sums, rate audits, stage times, evaluation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _trailing(events: DataFrame, by: list[str], ts: str, seconds: int, within: int, **sums: Column) -> DataFrame:
    """Adds columns over the events of a key in the `within` microseconds up to each row.

    Time is cut into spans of `seconds`: what a row looks back at lies in its own span or the one before, so each row also takes part, unseen,
    in the next span. Windows are per key and span, and a busy key's history is spread over many.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    spans = F.floor(at / (seconds * 1_000_000))
    every = events.withColumn("__at", at).withColumn("__span", F.explode(F.array(F.struct(spans.alias("no"), F.lit(True).alias("own")), F.struct((spans + 1).alias("no"), F.lit(False).alias("own")))))
    every = every.withColumns({"__no": F.col("__span.no"), "__own": F.col("__span.own")}).drop("__span")
    w = Window.partitionBy(*by, "__no").orderBy("__at").rangeBetween(-within, 0)
    return every.withColumns({k: c.over(w) for k, c in sums.items()}).where("__own").drop("__at", "__no", "__own")


def rolling(events: DataFrame, by: list[str], ts: str, value: str, seconds: int) -> DataFrame:
    """Adds rolling (sum) and calls (count) of a key's rows in the `seconds` up to each row, both ends included. Rows without a time are left out."""
    # both ends: spans are a second longer than the window, so that no row looks back further than one span
    return _trailing(events, by, ts, seconds + 1, seconds * 1_000_000, rolling=F.sum(value), calls=F.count("*"))


def over_limit(events: DataFrame, by: list[str], ts: str, most: int, seconds: int = 60) -> DataFrame:
    """The rows at which a key has more than `most` events within the trailing window. Rows without a time are left out."""
    return _trailing(events, by, ts, seconds, seconds * 1_000_000 - 1, calls=F.count("*")).where(F.col("calls") > most)


def longest_prefix(rows: DataFrame, table: DataFrame, value: str, prefix: str) -> DataFrame:
    """Each row with the table's row whose prefix of its value is the longest; rows without one keep nulls.

    Prefixes are looked up by their length, an equi-join per length that the table has.
    """
    sizes = [r[0] for r in table.select(F.length(prefix)).distinct().collect()]  # as many as there are lengths
    heads = rows.select(value).distinct().withColumn("__p", F.explode(F.array(*(F.substring(value, 1, n) for n in sizes))))
    best = heads.join(table, heads["__p"] == table[prefix]).groupBy(value).agg(F.max_by(F.struct(*table.columns), F.length(prefix)).alias("__t"))
    return rows.join(best, value, "left").select(*rows.columns, *(F.col(f"__t.{c}").alias(c) for c in table.columns))


def evaluated(found: DataFrame, must: DataFrame, never: DataFrame, case: str = "case_id", rule: str = "rule_id", severity: str = "severity") -> DataFrame:
    """case, tp, fn, fp, unexpected: expected items hit and missed, found items that are forbidden, and the other found ones.

    An item matches by rule, and by severity where the expectation has one.
    """
    f = found.select(case, rule, F.col(severity).alias("__s")).withColumn("__id", F.monotonically_increasing_id())
    same = F.col(severity).isNull() | (F.col(severity) == F.col("__s"))
    m = must.select(case, rule, severity).distinct()
    distinct_found = f.select(case, rule, "__s").distinct()
    hit = m.join(distinct_found, [case, rule]).where(same).select(case, rule, severity).distinct().groupBy(case).agg(F.count("*").alias("tp"))
    wanted = m.groupBy(case).agg(F.count("*").alias("wanted"))
    bad_keys = distinct_found.join(never.select(case, rule, severity).distinct(), [case, rule]).where(same).select(case, rule, "__s").distinct()
    good_keys = distinct_found.join(m, [case, rule]).where(same).select(case, rule, "__s").distinct()
    n = f.groupBy(case, rule, "__s").agg(F.count("*").alias("n"))
    fp = n.join(bad_keys, [case, rule, "__s"]).groupBy(case).agg(F.sum("n").alias("fp"))
    rest = n.join(bad_keys, [case, rule, "__s"], "left_anti").join(good_keys, [case, rule, "__s"], "left_anti").groupBy(case).agg(F.sum("n").alias("unexpected"))
    out = wanted.join(hit, case, "left").join(fp, case, "full").join(rest, case, "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.select(case, z("tp").alias("tp"), (z("wanted") - z("tp")).alias("fn"), z("fp").alias("fp"), z("unexpected").alias("unexpected"))


def scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """precision, recall, f1 from summed counts; both are 1 where nothing was found or wanted."""
    s = (counts.groupBy(*by) if by else counts.groupBy()).agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp", "unexpected")))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    return s.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
