"""The audit: from events to findings and graded sessions."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castellan.functions.evidence import with_evidence
from castellan.operators import grading, sessions
from castellan.operators.tables import cut, stored
from castellan.rules import shell, simple
from castellan.rules.base import Rule, egress_calls, findings, prepared_calls
from castellan.rules.catalog import SEVERITIES
from castellan.sources import transcripts

#: Registered rules; append to extend.
RULES: list[Rule] = [simple.integrity, shell.filesystem, shell.destructive, shell.credentials, simple.network, simple.remote_code, simple.persistence, simple.injection]


class Audit(NamedTuple):
    sessions: DataFrame
    findings: DataFrame
    results: DataFrame


def inputs(events: DataFrame, per_session: DataFrame) -> dict[str, DataFrame]:
    """What rules read: calls and results with all that is taken from them, and sessions."""
    own = {"event_index": F.lit(-1), "block": F.lit(0), "tool_name": F.lit("")}
    return {
        "sessions": per_session.where("tool_call_count = 0 and skipped_lines > 0").withColumns(own),
        "calls": simple.with_hosts(prepared_calls(sessions.calls(events), per_session)),
        "results": simple.readable_results(sessions.results(events)),
    }


def egress_of(events: DataFrame) -> DataFrame:
    """Calls with the hosts they contact, from the input alone."""
    return simple.with_hosts(egress_calls(sessions.calls(events)))


def audit_events(events: DataFrame, project_root: str | None = None, rules: Iterable[Rule] | None = None) -> Audit:
    """Findings and one graded row per session of typed events.

    Events are read several times (sessions, calls, results), a few columns each, so hand in
    a stored table.  All rules over calls run in one pass; findings are written once.
    """
    per_session = cut(sessions.sessions(events, project_root))
    read = inputs(events, per_session)
    # findings are few next to events; what follows plans and runs on them alone
    collapsed = cut(grading.collapse(with_evidence(cut(findings(RULES if rules is None else rules, read)))))
    counts = grading.severity_counts(collapsed)
    names = [f"n_{n}" for n in SEVERITIES]
    graded = grading.grades(per_session.join(counts, "session_key", "left").fillna(0, names))
    hosts = simple.contacted_hosts(egress_of(events))
    results = graded.join(hosts, "session_key", "left").withColumn("network_hosts", F.coalesce("network_hosts", F.array().cast("array<string>")))
    return Audit(per_session, collapsed, results)


def scan(spark: SparkSession, targets: Iterable[str], project_root: str | None = None) -> Audit:
    """Audit of transcript files, folders and globs."""
    events = stored(transcripts.events(transcripts.lines(spark, transcripts.discover(targets, spark))))
    return audit_events(events, project_root)
