import datetime as dt
import itertools
import json
import random

import pytest

from castellan.operators import drift, nested, orphans, rejects
from tests.helpers import T0, messages

DRIFT = "rec_id long, file_id long, stream_name string, file_name string, file_time timestamp, arrived_at timestamp, record string"


def drift_rows(spark, files):
    """files: (stream, file_id, hour, records)"""
    rec = itertools.count()
    rows = [(next(rec), f, s, f"{s}/{f}", T0 + dt.timedelta(hours=h), T0, r if r is None or isinstance(r, str) else json.dumps(r)) for s, f, h, rs in files for r in rs]
    return spark.createDataFrame(rows, DRIFT)


def changed(spark, files, aliases=None):
    seen = drift.field_sightings(drift_rows(spark, files), aliases or {})
    return sorted((r.file_id, r.field_path, r.change_kind) for r in drift.changes(drift.lifespans(seen)).collect())


def test_drift_changes(spark):
    files = [
        ("s", 1, 0, [{"type": "x", "session_id": 1, "m": {"a": [{"k": 1}]}}]),
        ("s", 2, 1, [{"type": None, "sessionId": 1, "m": {"a": [{"k": "v"}], "b": {"c": 1}}}]),
        ("s", 3, 2, [{"kind": 5, "sessionId": 2}, {"kind": "t", "sessionId": 2}]),
        ("s", 4, 3, [{"kind": "t", "sessionId": 2, "message": {"content": {"input": {"anything": 1}}}}]),
    ]
    assert changed(spark, files, {"kind": "type"}) == [
        (2, "m.a.k", "retyped"), (2, "m.b", "added"), (2, "sessionid", "renamed"),
        (3, "m", "removed"), (3, "type", "renamed"),
        (4, "message", "added"), (4, "type", "retyped"),
    ]


def test_drift_odd_records(spark):
    files = [("s", 1, 0, [None, "", "[1]", "not json", "3"]), ("s", 2, 0, [{"a": 1}]), (None, 3, 0, [{"a": 1}]), (None, 4, 1, [{}])]
    # equal times order by file_id; a null stream is a stream of its own
    assert changed(spark, files) == [(2, "a", "added"), (4, "a", "removed")]
    assert changed(spark, []) == []


def test_consistent_table(spark):
    rows = drift_rows(spark, [("s", 1, 0, [{"N": 1, "t": "x", "l": [{"v": 1}, {"v": "b"}]}, {"n": 2.5, "t": True}, None])]).selectExpr("*", "7 as n")
    plan, more = drift.table_plan(drift.casts(drift.field_sightings(rows, {})))
    assert plan == [("l__v".replace("__", "."), "string"), ("n", "double"), ("t", "string")]
    got = {r.rec_id: (r.n, r.t, r.l__v) for r in drift.consistent_table(rows, {}, plan).collect()}
    assert got == {0: (1.0, "x", '[1,"b"]'), 1: (2.5, "true", None), 2: (None, None, None)}


def test_values_beside_sub_fields_stay(spark):
    rows = drift_rows(spark, [("s", 1, 0, [{"cwd": "/a", "file_id": 1}, {"cwd": {"value": "/b"}}, {"cwd": 3}])])
    plan, more = drift.table_plan(drift.casts(drift.field_sightings(rows, {"fileid": "file_id"})))
    assert plan == [("cwd", "string"), ("cwd.value", "string"), ("file_id", "double")]
    table = drift.consistent_table(rows, {"fileid": "file_id"}, plan)
    assert {r.rec_id: (r.cwd, r.cwd__value, r.file_id__) for r in table.collect()} == {0: ("/a", None, 1.0), 1: ('{"value":"/b"}', "/b", None), 2: ("3", None, None)}


def test_lists_keep_the_shape_of_their_array(spark):
    records = [
        {"c": [{"t": "a", "n": "x"}, {"t": "b"}, "loose", {"n": "y", "p": [{"q": 1}, {}, {"q": 2}]}]},
        {"c": [{"p": [{"q": 3}]}, {"p": []}]},
        {"c": "plain", "d": [1, 2], "e": []},
    ]
    rows = drift_rows(spark, [("s", 1, 0, records)])
    plan, more = drift.table_plan(drift.casts(drift.field_sightings(rows, {})))
    assert [p for p, _ in plan] == ["c", "c.n", "c.p.q", "c.t", "d", "e"] and not more
    got = {r.rec_id: r for r in drift.consistent_table(rows, {}, plan).collect()}
    assert (got[0].c__t, got[0].c__n, got[0].c__p__q) == ('["a","b",null,null]', '["x",null,null,"y"]', "[null,null,null,[1,null,2]]")
    assert json.loads(got[0].c) == records[0]["c"] and (got[1].c__p__q, got[2].c, got[2].d, got[2].e) == ("[[3],null]", "plain", "[1,2]", "[]")
    assert {r.field_path: r.records for r in drift.values_per_path(rows, {}, plan).collect()} == {"c": 3, "c.n": 1, "c.p.q": 2, "c.t": 1, "d": 1, "e": 1}


def test_paths_beyond_the_columns_stay(spark, monkeypatch):
    monkeypatch.setattr(drift, "MAX_COLUMNS", 2)
    rows = drift_rows(spark, [("s", 1, 0, [{"a": 1, "b": "x", "c": 2, "d": {"e": [{"f": True}, {}]}}, {"a": 2, "b": "y"}, {"z": None}])])
    plan, more = drift.table_plan(drift.casts(drift.field_sightings(rows, {})))
    assert plan == [("a", "double"), ("b", "string")] and more
    got = {r.rec_id: (r.a, r.b, r.other_fields) for r in drift.consistent_table(rows, {}, plan, more).collect()}
    assert got == {0: (1.0, "x", {"c": "2", "d.e.f": "[true,null]"}), 1: (2.0, "y", {}), 2: (None, None, {})}


def test_nested_nodes_and_links(spark):
    record = {
        "type": "user",
        "message": {"content": ["hi", None, 3, {"type": "tool_result", "tool_use_id": "T", "content": [{"text": "x"}, "y", 4, {"type": "image"}]}, {"type": "tool_use", "id": "U"}, {"type": "tool_result", "content": "z"}, {}]},
        "toolUseResult": {"filePath": "/f", "structuredPatch": [{"oldStart": 1, "lines": ["a"]}, {}]},
    }
    rows = [(1, json.dumps(record)), (2, json.dumps({"type": "tool_use", "id": "top"})), (3, json.dumps({"message": {"content": "text"}})), (4, "null"), (5, None), (6, "[]"), (7, '{"message": [], "toolUseResult": "x"}')]
    nodes = nested.node_table(spark.createDataFrame(rows, "rec_id long, record string").selectExpr("*", "1 as kind", "2 as value"))
    got = sorted(((r.rec_id, r.node_path, r.node_type, r.link_key) for r in nodes.where("kind <> 'record'").collect()))
    assert got == sorted([
        (1, "content.0", "text", ""), (1, "content.3", "tool_result", "T"), (1, "content.3.content.0", "text", "T"), (1, "content.3.content.1", "text", "T"), (1, "content.3.content.3", "image", "T"),
        (1, "content.4", "tool_use", "U"), (1, "content.5", "tool_result", ""), (1, "content.5.content.0", "text", ""), (1, "content.6", "text", ""),
        (1, "toolUseResult.structuredPatch.0", "hunk", "/f"), (1, "toolUseResult.structuredPatch.1", "hunk", "/f"), (2, "self", "tool_use", "top"), (3, "content.0", "text", ""),
    ])
    every = [r for r in nodes.collect() if r.rec_id == 1]
    for n in every:  # the parent is the innermost interval around the node
        around = [m for m in every if m.pre < n.pre and n.post < m.post]
        assert n.parent_pre == (max(m.pre for m in around) if around else None)
    assert nested.record_table(nodes).count() == 4 and nested.part_table(nodes).count() == 4
    hunk = nested.hunk_table(nodes).where("ordinal = 0").first()
    assert (hunk.old_start, hunk.file_path, json.loads(hunk.lines)) == (1, "/f", ["a"])


def test_every_spelling_of_a_call_is_in_the_block_table(spark):
    given = {"command": "ls", "n": 1}
    spelled = [("name", "input"), ("tool", "params"), ("tool_name", "parameters"), ("tool", "input")]
    calls = [{"type": "tool_use", "id": f"c{i}", a: "Bash", b: given} for i, (a, b) in enumerate(spelled)]
    odd = [{"type": "tool_use", "name": "", "tool": "Read", "input": None, "params": {}}, {"type": "tool_use", "name": "Bare"}, "text"]
    rows = [(i, json.dumps(c)) for i, c in enumerate(calls)] + [(9, json.dumps({"message": {"content": calls + odd}}))]
    table = nested.block_table(nested.node_table(spark.createDataFrame(rows, "rec_id long, record string")))
    got = {(r.rec_id, r.node_path): (r.tool_name, r.tool_input and json.loads(r.tool_input)) for r in table.collect()}
    assert got == {(i, "self"): ("Bash", given) for i in range(4)} | {(9, f"content.{i}"): ("Bash", given) for i in range(4)} | {(9, "content.4"): ("Read", {}), (9, "content.5"): ("Bare", None), (9, "content.6"): (None, None)}


def test_record_table_has_the_message_and_the_result(spark):
    bash = {"stdout": "é\nout \ud800", "stderr": "", "interrupted": True, "isImage": False, "noOutputExpected": False}
    write = {"type": "update", "filePath": "/f", "content": "new", "originalFile": "old", "userModified": False, "structuredPatch": None}
    hunks = {"filePath": "/g", "userModified": "x", "structuredPatch": [{"oldStart": 1}]}
    results = [bash, write, hunks, "plain {", [], ["a", 1], {}, None, 5]
    rows = [(i, json.dumps({"type": "user", "cwd": "/w", "message": {"role": "user", "model": "m", "content": "hi"}, "toolUseResult": r})) for i, r in enumerate(results)]
    rows.append((9, json.dumps({"type": "tool_use", "name": "Bash", "input": {}})))
    table = nested.record_table(nested.node_table(spark.createDataFrame(rows, "rec_id long, record string")))
    got = {r.rec_id: r for r in table.collect()}
    assert [(got[i].message_role, got[i].message_model, got[i].cwd) for i in (0, 3, 9)] == [("user", "m", "/w"), ("user", "m", "/w"), (None, None, None)]
    assert [got[i].result_form for i in range(10)] == ["object"] * 3 + ["string", "array", "array", "object", None, "number", None]
    assert [got[i].result_text for i in range(10)] == [None] * 3 + ["plain {", "[]", '["a",1]', None, None, "5", None]
    assert (got[0].stdout, got[0].stderr, got[0].interrupted, got[0].is_image, got[0].no_output_expected) == ("é\nout ?", "", True, False, False)
    assert (got[1].result_type, got[1].result_file_path, got[1].result_content, got[1].original_file, got[1].user_modified) == ("update", "/f", "new", "old", False)
    assert (got[2].result_file_path, got[2].user_modified, got[6].stdout) == ("/g", None, None)


def test_records_at_the_edge_of_the_parser_keep_all(spark):
    deep, digits = "[" * 20_000 + "]" * 20_000, "7" * 6000
    odd = f'{{"type": "tool_use", "id": "a", "name": "Bash", "input": {{"n": {digits}, "deep": {deep}, "x": 1.10}}}}'
    rows = [(1, odd), (2, None), (3, ""), (4, "[1]"), (5, '{"a": NaN}'), (6, '{"message": {"content": [' + odd + "]}}"), (7, "null")]
    df = spark.createDataFrame(rows, "rec_id long, record string")
    given = f'{{"n":{digits},"deep":{deep},"x":1.10}}'
    assert sorted((r.rec_id, r.tool_name, r.tool_input) for r in nested.block_table(nested.node_table(df)).collect()) == [(1, "Bash", given), (6, "Bash", given)]
    assert sorted((r.rec_id, r.reason) for r in nested.unreadable(df).collect()) == [(2, "null"), (3, "syntax"), (4, "not_object"), (5, "syntax"), (7, "not_object")]
    assert changed(spark, [("s", 1, 0, ["{}"]), ("s", 2, 1, [odd, f'{{"m": {deep}, "k": {digits}}}'])]) == sorted((2, p, "added") for p in ("type", "id", "name", "input", "k", "m"))
    table = drift.consistent_table(drift_rows(spark, [("s", 1, 0, [f'{{"m": {deep}, "k": {digits}, "d": 1.10}}'])]), {}, [("d", "string"), ("k", "string"), ("m", "string")]).first()
    assert (table.d, table.k, table.m) == ("1.10", digits, deep)


def test_orphans(spark):
    call = lambda i, **k: {"session_id": "S", "src_path": "/f.jsonl", "line_no": i, "msg_role": "model", "tool_name": "Bash"} | k
    at = lambda d: dt.datetime(2025, 1, d)
    ms = messages(spark, [
        call(0, content_id=" a ", ingest_ts=at(1)), call(1, content_id="b", ingest_ts=at(1)), call(2, content_id="b", ingest_ts=at(9)), call(3, content_id="c", tool_name=" "), call(4, content_id="d", ingest_ts=at(1)),
        {"row_id": 50, "session_id": "s", "src_path": "/f.jsonl", "line_no": 5, "msg_role": "user", "tool_use_id": "a"},
        {"row_id": 51, "session_id": "s", "src_path": "/f.jsonl", "line_no": 6, "msg_role": "user", "tool_use_id": "A", "ingest_ts": at(2)},
        {"row_id": 52, "session_id": "s", "src_path": "/f.jsonl", "line_no": 6, "msg_role": "user", "tool_use_id": "a", "ingest_ts": at(1)},
    ])
    results = spark.createDataFrame([(1, "s", "b", at(3)), (2, "s", "c", at(3)), (3, "s", "d", None), (4, "other", "a", at(3)), (5, "s", "​", at(3)), (6, None, "a", at(3))], "result_id long, session_id string, tool_use_id string, returned_at timestamp")
    findings = spark.createDataFrame([(1, " S", "a", at(3)), (2, "gone", None, at(3)), (3, None, "a", at(3))], "finding_id long, session_id string, call_id string, seen_at timestamp")
    files = spark.createDataFrame([("/x/s.jsonl", None)], "src_path string, session_id string")
    deletions = spark.createDataFrame([("s", "b", at(5)), ("s", " d", at(5)), ("s", "d", at(1)), ("s", "a", at(1))], "session_id string, content_id string, deleted_at timestamp")
    lost = orphans.orphans(*orphans.references(ms, results, findings, files, deletions))
    assert sorted((r.ref_table, r.ref_column, r.ref_key) for r in lost.collect()) == [
        ("findings", "call_id", 3), ("findings", "session_id", 2), ("session_messages", "tool_use_id", 51),
        ("tool_results", "tool_use_id", 2), ("tool_results", "tool_use_id", 3), ("tool_results", "tool_use_id", 4), ("tool_results", "tool_use_id", 6),
    ]
    assert {(r.ref_table, r.month): r.orphans for r in orphans.report(lost).collect()}[("tool_results", None)] == 1
    empty = [df.limit(0) for df in (ms, results, findings, files, deletions)]
    assert orphans.orphans(*orphans.references(*empty)).count() == 0


GOOD = "s1,/p,/root,1,0,2,A,90,2025-01-01T00:00:00Z"


@pytest.mark.parametrize("line, reason", [
    (GOOD, None), ('"s,1","/p ""q""",,1,0,2,F,0,', None), ('s1,"/p,/root,1,0,2,A,90,', "quoting"), ('s1,/p "x",,1,0,2,A,90,', "quoting"), ('s1,"/p"x,,1,0,2,A,90,', "quoting"),
    ('"/a \\"b\\" c",/p,,1,0,2,A,90,', "quoting"), (GOOD + ",", "column_count"), ("s1;/p;x", "column_count"), ("s1,/p", "column_count"), (",/p,,1,0,2,A,90,", "invalid_value"), ("s1,/p,,-1,0,2,A,90,", "invalid_value"),
    ("s1,/p,,1,0,2,E,90,", "invalid_value"), ("s1,/p,,1,0,2,a,90,", "invalid_value"), ("s1,/p,,1,0,2,A,101,", "invalid_value"), ("s1,/p,,1,0,2,A,9.5,", "invalid_value"), ("s1,/p,,1,0,2,A,90,yesterday", "invalid_value"),
    ("s1,/p,,٣,0,2,A,90,", "invalid_value"), ('"s1""', "quoting"), ('""', "column_count"), ("s1,/p,,1,0,2,A,,", "invalid_value"), ('s1,"' + "x" * 300_000 + '",,1,0,2,A,90,', None), ("s1,/p\rq,,1,0,2,A,90,", None),
    ("s1,/p,,1,0,2,A,00000999,", "invalid_value"), ("s1,/p,,1,0,2,A,0000000099,", None), ("s1,/p,,1,0,2,A,-0,", None), ("s1,/p,,1,0,2,A,-1,", "invalid_value"), ("s1,/p,," + "9" * 60 + ",0,2,A,90,", None), ("s1,/p,,1.0,0,2,A,90,", "invalid_value"),
    ("s1,/p,,1_0,0,2,A,90,", "invalid_value"), ("s1,/p,, 1,0,2,A,90,", "invalid_value"), ("s1,/p\nq,,1,0,2,A,90,", None), ("s1,/p\x00,,1,0,2,A,90,", None), ("\ufeffs1,/p,,1,0,2,A,90,", None), ('"s1,/p,,1,0,2,A,90,', "quoting"), ('"fence"', "column_count"), ('1,"fence"', "column_count"),
])
def test_csv_reasons(line, reason):
    got = rejects.csv_verdicts([GOOD, line, GOOD])
    assert [r for r, _ in got] == [None, reason, None]
    assert got[0][1] == GOOD.split(",")


@pytest.mark.parametrize("text, reason", [
    ('{"type": "user"}', None), ('{"type": "user", "timestamp": null}', None), ('{"type": "user", "timestamp": ""}', "invalid_value"), ('{"type": "User"}', "invalid_value"), ("{}", "invalid_value"), ('{"type": "user", "n": NaN}', "syntax"),
    ('{"type": "user",}', "syntax"), ("[1]", "not_object"), ("3", "not_object"), ('{"type": "user"} x', "syntax"), ('{"type": "user", "n": 01}', "syntax"), ("{'type': 'user'}", "syntax"), ('{"type": "user", "s": "a\tb"}', "syntax"),
    (' {"type": "summary", "timestamp": "2025-01-01 00:00:00Z"}\r', None), ('{"type": "user", "n": ' + "9" * 6000 + "}", None), (' {"type": "user"}', "syntax"), ("[" * 100_000, "syntax"),
    ('{"type": "user", "deep": ' + "[" * 100_000 + "]" * 100_000 + "}", None), ('{"type": "user", "deep": ' + "[" * 100_000 + "]" * 99_999 + "}", "syntax"),
])
def test_json_reasons(text, reason):
    assert rejects.json_reason(text) == reason


def test_rejects_as_tables(spark):
    rows = [
        (1, "a.csv", 0, "csv", "session_id,...", None), (2, "a.csv", 1, "csv", GOOD, None), (3, "a.csv", 2, "csv", "x", None), (4, "a.csv", 3, "csv", " ​", None), (5, "b", 0, "jsonl", '{"type":"user","sessionId":"q"}', None),
        (6, "b", None, "JSONL ", "null", None), (7, "c", 1, "xml", "<a/>", None), (8, "a.csv", 1, "csv", GOOD, None), (9, "c", 1, None, None, None), (10, "a.csv", None, "csv", GOOD, None),
    ]
    judged = rejects.verdicts(spark.createDataFrame(rows, "raw_id long, src_file string, line_no int, line_format string, raw_text string, loaded_at timestamp").selectExpr("*", "0 as reason", "1 as fields"))
    assert sorted((r.raw_id, r.reason) for r in rejects.failures(judged).collect()) == [(3, "column_count"), (6, "not_object"), (7, "unknown_format")]
    assert sorted((r.raw_id, r.event_count, r.first_ts) for r in rejects.csv_rows(judged).collect()) == [(i, 1, "2025-01-01T00:00:00Z") for i in (2, 8, 10)]
    assert [(r.raw_id, r.session_id) for r in rejects.jsonl_rows(judged).collect()] == [(5, "q")]


def test_csv_against_a_state_machine():
    def fields(line):  # RFC 4180, character by character
        out, i = [], 0
        while True:
            if line[i : i + 1] == '"':
                i += 1
                cell = ""
                while True:
                    j = line.find('"', i)
                    if j < 0:
                        return None
                    cell += line[i:j]
                    i = j + 1
                    if line[i : i + 1] != '"':
                        break
                    cell += '"'
                    i += 1
                if line[i : i + 1] not in ("", ","):
                    return None
            else:
                j = line.find(",", i)
                j = len(line) if j < 0 else j
                cell = line[i:j]
                if '"' in cell:
                    return None
                i = j
            out.append(cell)
            if i >= len(line):
                return out
            i += 1

    rng = random.Random(3)
    lines = ["".join(rng.choice(['"', ",", "a", '""', '","', " ", "\r", "\n", '\n"']) for _ in range(rng.randrange(1, 25))) + "x" for _ in range(6000)]
    for line, (reason, got) in zip(lines, rejects.csv_verdicts(lines)):
        want = fields(line)
        assert (reason == "quoting") == (want is None), line
        if want is not None and len(want) != 9:
            assert reason == "column_count", line
