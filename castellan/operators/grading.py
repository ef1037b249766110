"""Repeats collapsed, findings ordered, sessions graded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castellan.rules import catalog as C

#: Event indices that one partial group holds while repeats are collapsed.
INDEX_BLOCK = 10_000


def collapse(findings: DataFrame, order: str = "emit", keep: int = C.ALSO_AT) -> DataFrame:
    """One row per session, rule, title and evidence: the first in ``order``, with the
    number of occurrences and the smallest other event indices.

    Nulls in the keys are equal to each other.  Two steps of grouping keep any group small:
    first by event, then by blocks of events, so that a finding repeated in a third of all
    rows is reduced where it lies.
    """
    key = ["session_key", "rule_id", "title", "evidence"]
    rest = [c for c in findings.columns if c not in (*key, order)]
    body = F.struct(*rest)
    per_event = findings.groupBy(*key, "event_index").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"), F.min_by(body, order).alias("b"))
    seen = F.struct(F.col("event_index").alias("i"), F.col("n"))
    per_block = per_event.groupBy(*key, F.floor(F.col("event_index") / INDEX_BLOCK).alias("_block")).agg(
        F.sum("n").alias("n"), F.min("o").alias("o"), F.min_by("b", "o").alias("b"), F.slice(F.array_sort(F.collect_list(seen)), 1, keep + 1).alias("s")
    )
    whole = per_block.groupBy(*key).agg(
        F.sum("n").alias("occurrences"), F.min("o").alias(order), F.min_by("b", "o").alias("b"), F.flatten(F.array_sort(F.collect_list(F.struct("_block", "s")))["s"]).alias("s")
    )
    others = F.filter("s", lambda x: (x["n"] > 1) | (x["i"] != F.col("b.event_index")))
    return whole.select(
        *key, *(F.col(f"b.{c}").alias(c) for c in rest), order, "occurrences", F.slice(F.transform(others, lambda x: x["i"]), 1, keep).alias("also_at")
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row per session with findings: their number by severity, zero filled."""
    return findings.groupBy("session_key").agg(*(F.count_if(F.col("severity") == i).alias(f"n_{name}") for i, name in enumerate(C.SEVERITIES)), F.max("severity").alias("worst"))


def score() -> Column:
    out = F.lit(100).cast("long")
    for level, weight in C.WEIGHTS.items():
        lost = F.col(f"n_{C.SEVERITIES[level]}") * weight
        out = out - (lost if C.CAPS[level] is None else F.least(lost, F.lit(C.CAPS[level]).cast("long")))
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(100).cast("long"), out))


def letter(points: Column) -> Column:
    out = None
    for name, least in C.LETTERS:
        out = F.when(points >= least, name) if out is None else out.when(points >= least, name)
    return out


def grades(counts: DataFrame) -> DataFrame:
    """Adds grade_score and grade to severity counts.  Any critical finding gives F; any
    high one keeps the score at most HIGH_CEILING."""
    points = score()
    capped = F.when((F.col("n_high") > 0) & (F.col("n_critical") == 0), F.least(points, F.lit(C.HIGH_CEILING).cast("long"))).otherwise(points)
    return counts.withColumn("grade_score", capped).withColumn("grade", F.when(F.col("n_critical") > 0, "F").otherwise(letter(F.col("grade_score"))))


def grade_rank(c: Column) -> Column:
    g = F.upper(F.trim(c))
    out = F.when(g == "F", 4)
    for i, (name, _) in enumerate(C.LETTERS[:4]):
        out = out.when(g == name, i)
    return out.otherwise(0)


def report_order() -> list[Column]:
    """Within a session: worst first, then category, event and order of emission."""
    return [F.desc("severity"), F.col("category"), F.col("event_index"), F.col("emit")]


def in_report_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("session_key", *report_order())


def summary_lines(results: DataFrame) -> DataFrame:
    """(session_key, line) as the fleet summary shows each session."""
    bits = F.concat_ws(", ", *(F.when(F.col(f"n_{n}") > 0, F.concat(F.col(f"n_{n}").cast("string"), F.lit(f" {n}"))) for n in reversed(C.SEVERITIES)))
    total = sum((F.col(f"n_{n}") for n in C.SEVERITIES), F.lit(0))
    marks = F.concat_ws(", ", *(F.when(F.col(c) > 0, F.concat(F.lit("!"), F.col(c).cast("string"), F.lit(f" {w}"))) for c, w in (("skipped_lines", "unreadable"), ("truncated_results", "truncated"))))
    line = F.format_string(
        "  %s (%3d/100)  %-24s  %2d total%s  %s  %s  %s", F.col("grade"), F.col("grade_score"), F.when(bits == "", "clean").otherwise(bits), total.cast("long"),
        F.when(marks != "", F.concat(F.lit("  "), marks)).otherwise(""), F.coalesce("last_ts", "first_ts", F.lit("-")), F.col("session_id"), F.col("session_key"),
    )
    return results.select("session_key", line.alias("line"), "worst", "grade_score", "grade")


def fleet_order(by_path: bool = False) -> list[Column]:
    """Worst session first; sessions without findings last; or by path."""
    return [F.col("session_key")] if by_path else [F.coalesce(-F.col("worst"), F.lit(1)), F.col("grade_score"), F.col("session_key")]


def in_fleet_order(results: DataFrame, by_path: bool = False) -> DataFrame:
    return results.orderBy(*fleet_order(by_path))


def at_least(results: DataFrame, grade: str | None) -> DataFrame:
    return results.where(grade_rank(F.col("grade")) >= grade_rank(F.lit(grade))) if grade else results
