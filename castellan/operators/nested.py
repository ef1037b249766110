"""Deeply nested records as flat node tables linked by interval containment.

A depth-first walk of each record gives every emitted node a pre-order and a post-order
number.  Node A is an ancestor of node B exactly if ``A.pre < B.pre and B.post < A.post``;
the parent is the innermost such node.  Links are found from the labels alone, with one
pass over the nodes of a record in pre-order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castellan.functions import jsontext

NODES = "rec_id long, pre int, post int, parent_pre int, parent_path string, kind string, node_path string, ordinal int, node_type string, link_key string, result_form string, members map<string,string>"


def _text(x: object) -> str:
    return x if isinstance(x, str) else ""


def _kind(x: object) -> str | None:
    """Type of a block or part; null for what is no node."""
    if isinstance(x, str):
        return "text"
    if isinstance(x, dict):
        return x["type"] if isinstance(x.get("type"), str) else "text"
    return None


def walk(record: object) -> list[dict]:
    """Labelled nodes of one parsed record, in pre-order; the record itself is the first.

    Anything that is no object gives no nodes.  Elements that are neither objects nor
    strings are no nodes but keep their place in the numbering of paths.  The record's own
    node has ``result_form``, the JSON type of its toolUseResult (null for none).  A node's
    ``value`` is its part of the record.
    """
    if not isinstance(record, dict):
        return []
    out: list[dict] = []
    clock = 0

    def enter(kind: str, path: str, ordinal: int | None, node_type: str, link: str, value: object) -> dict:
        nonlocal clock
        node = {"pre": clock, "kind": kind, "node_path": path, "ordinal": ordinal, "node_type": node_type, "link_key": link, "value": value}
        clock += 1
        out.append(node)
        return node

    def leave(node: dict) -> None:
        nonlocal clock
        node["post"] = clock
        clock += 1

    root = enter("record", "", None, _text(record.get("type")), "", record)
    message, result = record.get("message"), record.get("toolUseResult")
    root["result_form"] = jsontext.kind_of(result)
    if message is None and record.get("type") == "tool_use":
        leave(enter("block", "self", None, "tool_use", _text(record.get("id")), record))
    content = message.get("content") if isinstance(message, dict) else None
    for i, block in enumerate([content] if isinstance(content, str) else content if isinstance(content, list) else []):
        kind = _kind(block)
        if kind is None:
            continue
        link = _text(block.get("tool_use_id" if kind == "tool_result" else "id")) if kind in ("tool_result", "tool_use") and isinstance(block, dict) else ""
        node = enter("block", f"content.{i}", i, kind, link, block)
        if kind == "tool_result" and isinstance(block, dict):
            inner = block.get("content")
            for j, part in enumerate([inner] if isinstance(inner, str) else inner if isinstance(inner, list) else []):
                if (pk := _kind(part)) is not None:
                    leave(enter("part", f"content.{i}.content.{j}", j, pk, link, part))
        leave(node)
    if isinstance(result, dict) and isinstance(result.get("structuredPatch"), list):
        file_path = _text(result.get("filePath"))
        for j, hunk in enumerate(result["structuredPatch"]):
            if isinstance(hunk, dict):
                leave(enter("hunk", f"toolUseResult.structuredPatch.{j}", j, "hunk", file_path, hunk))
    leave(root)
    return out


def link(nodes: list[dict]) -> None:
    """Gives every node (in pre-order) the innermost node whose interval contains its own."""
    open_: list[dict] = []
    for n in nodes:
        while open_ and open_[-1]["post"] < n["pre"]:
            open_.pop()
        n["parent_pre"] = open_[-1]["pre"] if open_ else None
        n["parent_path"] = open_[-1]["node_path"] if open_ else None
        open_.append(n)


def members(node: dict) -> list[tuple[str, str]]:
    """Fields of a node as texts, without nulls: those of its object by name, a string as
    'text'.  A record has those of its message and toolUseResult by path, without what
    becomes nodes of its own."""
    value = node["value"]
    if not isinstance(value, dict):
        return [("text", jsontext.shown(value))]
    found = dict(value)
    if node["kind"] == "record":
        for name, nodes in (("message", "content"), ("toolUseResult", "structuredPatch")):
            if isinstance(value.get(name), dict):
                del found[name]
                found |= {f"{name}.{k}": v for k, v in value[name].items() if k != nodes or not isinstance(v, (list, str) if name == "message" else list)}
    elif node["node_type"] == "tool_result":
        found.pop("content", None)
    return [(jsontext.shown(k), t) for k, v in found.items() if (t := jsontext.shown(v)) is not None]


def labelled(text: str | None) -> list[dict]:
    """Nodes of a record's text with their parents; one of kind 'unreadable', whose type is
    the reason, for a null, a text that is no JSON and a value that is no object."""
    try:
        record = jsontext.parse(text) if text is not None else None
        reason = "null" if text is None else "not_object"
    except ValueError:
        record, reason = None, "syntax"
    nodes = walk(record)
    link(nodes)
    return nodes or [{"kind": "unreadable", "pre": 0, "post": 1, "node_path": "", "node_type": reason, "link_key": "", "value": None}]


def _every_node(records: DataFrame, with_members: bool) -> DataFrame:
    fields = [x.strip().split(" ") for x in NODES.rsplit(",", 2)[0].split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [n | {"rec_id": rec_id} for rec_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n in labelled(text)]
            for n in rows:
                n["node_type"], n["link_key"] = jsontext.shown(n["node_type"]), jsontext.shown(n["link_key"])
            own = pa.array([members(n) if with_members and n["kind"] != "unreadable" else None for n in rows], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*(pa.array([r.get(k) for r in rows], kinds[t]) for k, t in fields), own], names=[*(k for k, _ in fields), "members"])

    return records.select("rec_id", "record").mapInArrow(label, NODES)


def node_table(records: DataFrame, with_members: bool = True) -> DataFrame:
    """All nodes of all records (narrow: no shuffle).  Records that can't be read have none,
    see ``unreadable``; repeated rec_ids give repeated nodes."""
    return _every_node(records, with_members).where("kind <> 'unreadable'")


def unreadable(records: DataFrame) -> DataFrame:
    """rec_id of records that give no nodes, with the reason: null, syntax or not_object."""
    return _every_node(records, False).where("kind = 'unreadable'").select("rec_id", F.col("node_type").alias("reason"))


def _field(name: str, kind: str = "string") -> Column:
    return F.col("members")[name].try_cast(kind)


def _spelled(*names: str) -> Column:
    """The first of the fields that isn't empty, else the first that is there."""
    return F.coalesce(*(F.nullif(_field(n), F.lit("")) for n in names), *(_field(n) for n in names))


#: Fields of a toolUseResult object beside its hunks: (name, column, type).
RESULT_FIELDS = (
    ("type", "result_type", "string"), ("filePath", "result_file_path", "string"), ("content", "result_content", "string"), ("originalFile", "original_file", "string"), ("userModified", "user_modified", "boolean"),
    ("stdout", "stdout", "string"), ("stderr", "stderr", "string"), ("interrupted", "interrupted", "boolean"), ("isImage", "is_image", "boolean"), ("noOutputExpected", "no_output_expected", "boolean"),
)


def record_table(nodes: DataFrame) -> DataFrame:
    """One row per record with its message's own fields and its toolUseResult.

    ``result_form`` is the JSON type of the toolUseResult; one that is no object is
    ``result_text`` (a string as it is, else its JSON), an object fills the columns of
    RESULT_FIELDS.
    """
    form = F.col("result_form")
    return nodes.where("kind = 'record'").select(
        "rec_id", "pre", "post", F.col("node_type").alias("record_type"), _field("cwd").alias("cwd"), _field("sessionId").alias("session_id"), _field("timestamp").alias("ts_text"),
        _field("message.role").alias("message_role"), _field("message.model").alias("message_model"), "result_form", F.when(form != "object", _field("toolUseResult")).alias("result_text"),
        *(F.when(form == "object", _field(f"toolUseResult.{n}", t)).alias(a) for n, a, t in RESULT_FIELDS),
    )


def block_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'block'").select(
        "rec_id", "pre", "post", "parent_pre", "node_path", "ordinal", F.col("node_type").alias("block_type"), "link_key",
        _spelled("name", "tool", "tool_name").alias("tool_name"), _spelled("input", "parameters", "params").alias("tool_input"), _field("text").alias("text"),
    )


def part_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'part'").select(
        "rec_id", "pre", "post", "parent_pre", "parent_path", "node_path", "ordinal", F.col("node_type").alias("part_type"), "link_key",
        _field("text").alias("text"), _field("source").alias("source"),
    )


def hunk_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'hunk'").select(
        "rec_id", "pre", "post", "parent_pre", "node_path", "ordinal", F.col("link_key").alias("file_path"),
        *(_field(n, "int").alias(a) for n, a in (("oldStart", "old_start"), ("oldLines", "old_lines"), ("newStart", "new_start"), ("newLines", "new_lines"))), _field("lines").alias("lines"),
    )
