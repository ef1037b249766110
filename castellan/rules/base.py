"""Common form of findings, and what rules read.

A rule is a column: the array of its hits in one call, one result or one session.  All
rules over calls are evaluated in one pass over the calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castellan.functions import lexers, paths
from castellan.operators.sessions import first_string
from castellan.rules import catalog as C

FINDING = "struct<tag: string, severity: int, title: string, detail: string, evidence: string, remediation: string>"
NONE = f"array<{FINDING}>"
COLUMNS = ["session_key", "rule_id", "category", "severity", "title", "detail", "evidence", "event_index", "tool_name", "remediation", "emit"]
#: Event indices of a session that share one row of its attributes when calls are joined with them.
JOIN_BLOCK = 10_000


class Rule(NamedTuple):
    """``hits`` makes an array of findings (nulls are none) from the columns of ``over``:
    'calls', 'results' or 'sessions'."""

    rule_id: str
    over: str
    hits: Callable[[], Column]


def hit(when: Column, tag: Column | str, severity: Column | int, title: Column | str, detail: Column | str, text: Column, fix: Column | str) -> Column:
    """A finding where ``when`` holds, else null."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    body = F.struct(
        col(tag).alias("tag"), col(severity).cast("int").alias("severity"), col(title).alias("title"), col(detail).alias("detail"), text.alias("evidence"), col(fix).alias("remediation")
    )
    return F.when(when, body)


_MADE: dict[tuple[Rule, object], Column] = {}


def _tagged(rule: Rule) -> Column:
    """Hits of a rule with its number.  A rule's column names no table, so it is put together
    once in the life of an engine."""
    made = (rule, SparkContext._gateway)
    if made not in _MADE:
        real = F.filter(F.coalesce(rule.hits(), F.array().cast(NONE)), lambda x: x.isNotNull())
        _MADE[made] = F.transform(real, lambda x: F.struct(F.lit(int(rule.rule_id[-1])).alias("rule"), x.alias("hit")))
    return _MADE[made]


def _flat(rows: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """One row per hit of any rule: one array, exploded once."""
    found = rows.select("session_key", "event_index", "block", "tool_name", F.posexplode(F.concat(*map(_tagged, rules))).alias("_pos", "_f"))
    emit = F.struct(F.col("_f.rule").alias("rule"), F.col("event_index").alias("line"), "block", F.col("_pos").alias("pos"))
    return found.select("session_key", "event_index", "tool_name", emit.alias("emit"), F.col("_f.hit").alias("hit"))


def findings(rules: Iterable[Rule], inputs: dict[str, DataFrame]) -> DataFrame:
    """Findings of all rules; of equal tags of a rule in one event the first counts.
    ``emit`` orders findings as they were found.  Evidence is still raw."""
    own = {over: [r for r in rules if r.over == over] for over in inputs}
    flat = reduce(DataFrame.unionByName, (_flat(inputs[over], rs) for over, rs in own.items() if rs))
    # grouping by event pre-aggregates per task, and no group is hot
    first = flat.groupBy("session_key", "event_index", F.col("emit.rule").alias("_rule"), F.col("hit.tag").alias("_tag")).agg(F.min_by(F.struct("hit", "tool_name", "emit"), "emit").alias("f"))
    known = [*C.RULES.items()]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_rule") + 1)
    h = lambda n: F.col(f"f.hit.{n}").alias(n)
    return first.select(
        "session_key", of([r for r, _ in known]).alias("rule_id"), of([c for _, (c, _) in known]).alias("category"), h("severity"), h("title"), h("detail"), h("evidence"),
        "event_index", F.col("f.tool_name").alias("tool_name"), h("remediation"), F.col("f.emit").alias("emit"),
    )


def prepared_calls(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """Calls with what rules read of them: command with and without heredoc bodies, path,
    URL, MCP parts, sub-commands, and the root and home of their session.

    Each block of events of a session meets its own row of attributes, so a session of any
    size is spread over the tasks of the join.
    """
    kind, v = F.col("tool_kind"), F.col("_v")
    none = F.array().cast("array<string>")
    blocks = F.sequence(F.lit(0), F.greatest(F.floor(F.col("last_event") / JOIN_BLOCK).cast("int"), F.lit(0)))
    facts = sessions.where("tool_call_count > 0").select("session_key", "project_root", "home", F.explode(blocks).alias("_part"))
    rows = calls.withColumn("_part", F.floor(F.col("event_index") / JOIN_BLOCK).cast("int")).join(facts, ["session_key", "_part"]).drop("_part")
    # one projection per step: the input is parsed once, not once per field
    staged = (
        rows.withColumn("_v", F.try_parse_json("input_json"))
        .withColumn("_mcp", lexers.mcp_parts(F.when(kind == "mcp", F.col("input_json"))))
        .withColumns(
            {
                "cmd_raw": F.when(kind == "bash", first_string(v, "command")).otherwise(""),
                "file": F.when(kind.isin("read", "write", "edit"), paths.posix_path_column(first_string(v, *C.PATH_FIELDS))).otherwise(""),
                "_url": F.when(kind == "web", first_string(v, "url", "query")).otherwise(""),
                "mcp_paths": F.coalesce(F.transform("_mcp.paths", paths.posix_path_column), none),
                "mcp_cmd": F.coalesce("_mcp.command", F.lit("")),
                "root": F.when(F.col("project_root") != "", paths.normal(F.col("project_root"))),
            }
        )
    )
    blanked = F.regexp_replace("cmd_raw", C.java("(?s)" + C.HEREDOC, False), "$1 $2$3$2\n<heredoc body omitted>\n$3")
    staged = staged.withColumns(
        {
            "cmd": F.when(F.instr("cmd_raw", "<<") > 0, blanked).otherwise(F.col("cmd_raw")),
            "egress": F.when(kind == "bash", F.col("cmd_raw")).when(kind == "web", F.col("_url")).when(kind == "mcp", F.coalesce("_mcp.flat", F.lit(""))).otherwise(""),
            "raw_command": F.when(kind == "bash", F.col("cmd_raw")).when(kind == "mcp", F.col("mcp_cmd")).otherwise(""),
        }
    ).drop("_mcp", "_v", "_url")
    command = F.when(kind == "bash", F.col("cmd")).when(kind == "mcp", F.col("mcp_cmd")).otherwise("")
    return staged.withColumns(
        {
            "command": command,
            "_parts": lexers.sub_commands(F.nullif(command, F.lit(""))),
            "flat": F.coalesce(lexers.flat_input(F.when(kind.isin("write", "edit"), F.col("input_json"))), F.lit("")),
        }
    ).withColumns({"segments": F.col("_parts.segments"), "pipelines": F.when(kind == "bash", F.col("_parts.pipelines")).otherwise(none)}).drop("_parts")


def egress_calls(calls: DataFrame) -> DataFrame:
    """(session_key, egress) of the calls that have a text which can name hosts."""
    kind, v = F.col("tool_kind"), F.col("_v")
    rows = calls.where("tool_kind in ('bash', 'web', 'mcp')").select("session_key", "tool_kind", "input_json")
    rows = rows.withColumns({"_v": F.try_parse_json("input_json"), "_mcp": lexers.mcp_parts(F.when(kind == "mcp", F.col("input_json")))})
    text = F.when(kind == "bash", first_string(v, "command")).when(kind == "web", first_string(v, "url", "query")).otherwise(F.coalesce("_mcp.flat", F.lit("")))
    return rows.select("session_key", text.alias("egress")).where("egress <> ''")
