import datetime as dt
import itertools
import random
import re

from castellan.llm import conversations, repeats
from castellan.operators.messages import ROLES
from tests.helpers import T0, messages


def random_messages(seed, n=1500):
    rng = random.Random(seed)
    rows, where = [], {}
    for _ in range(n):
        s = rng.choice(["hot"] * 6 + ["b", "c", "d", "e", "f", "g"])
        f = f"/{s}.{rng.randrange(2)}.jsonl"
        line = where.get(f, 0)
        where[f] = line + 1 + (rng.random() < 0.001)
        kind = rng.choice(["prompt", "reply", "reply", "call", "call", "result", "silent", "system", "empty"])
        who = {"prompt": "user", "result": "Human ", "system": "system", "empty": "user"}.get(kind, "assistant")
        rows.append({
            "session_id": rng.choice([s, s.upper(), f" {s}​", None]), "src_path": f, "line_no": line, "msg_role": who if rng.random() < 0.999 else "tool", "event_type": None,
            "ts_text": rng.choice([None, "bad", f"2025-01-01T00:{rng.randrange(60):02d}:00Z"]), "body": None if kind in ("silent", "empty", "call") else rng.choice(["hi", " "]) if kind == "reply" else "text",
            "content_id": "c" if kind == "call" else None, "tool_name": rng.choice(["Bash", "bash "]) if kind == "call" else None, "tool_input": rng.choice(['{"a": 1}', '{"A":2}', "x"]) if kind == "call" else None,
            "tool_use_id": "c" if kind == "result" else " ",
        })
    rng.shuffle(rows)
    return rows


def ordered(rows):
    """Kept rows of each session in order, by plain Python."""
    sessions, files = {}, {}
    for r in rows:
        files.setdefault(r["src_path"], []).append(r)
    for f, rs in files.items():
        last = None
        for r in sorted(rs, key=lambda r: r["line_no"]):
            last = r["ts_text"] if r["ts_text"] and r["ts_text"][0] == "2" else last
            key = (r["session_id"] or "").strip(" ​").lower() or f.rsplit("/", 1)[1].split(".")[0]
            sessions.setdefault(key, []).append(((last is not None, last or "", f, r["line_no"]), r))
    return {k: [r for _, r in sorted(v, key=lambda x: x[0])] for k, v in sessions.items()}, files


def bad_sessions(rows):
    sessions, files = ordered(rows)
    bad = {k for k, rs in sessions.items() for f in {r["src_path"] for r in rs} if sorted(x["line_no"] for x in files[f]) != list(range(len(files[f])))}
    full = lambda s: bool(s and s.strip(" ​"))
    for k, rs in sessions.items():
        roles = [ROLES.get(r["msg_role"].strip().lower()) for r in rs]
        prompt = [a == "user" and not full(r["tool_use_id"]) for a, r in zip(roles, rs)]
        is_call = [a == "assistant" and full(r["content_id"]) and full(r["tool_name"]) for a, r in zip(roles, rs)]
        reply = [c or a == "assistant" and full(r["body"]) for c, a, r in zip(is_call, roles, rs)]
        talk = [p for a, p in zip(roles, prompt) if a != "system"]
        some = any(a in ("user", "assistant") and (full(r["body"]) or c or full(r["tool_use_id"])) for a, c, r in zip(roles, is_call, rs))
        turns = "".join("p" if p else "r" if a else "" for p, a in zip(prompt, reply))
        if None in roles or not some or not talk or not talk[0] or re.search("p(p|$)", turns):
            bad.add(k)
    return bad


def test_dropped_conversations_equal_brute_force(spark):
    for seed in range(2):
        rows = random_messages(seed)
        got = {r.session_key for r in conversations.dropped(conversations.placed(messages(spark, rows))).collect()}
        assert got == bad_sessions(rows)


def good_rows(n):
    row = lambda s, i, **k: {"session_id": s, "src_path": f"/{s}.jsonl", "line_no": i, "ts_text": "2025-01-01T00:00:00Z"} | k
    turns = [row("hot", i, msg_role="user" if i % 2 == 0 else "model", body="x") for i in range(n)]
    return turns + [row("tiny", 0, event_type="user", body="q"), row("tiny", 1, msg_role="assistant", body="a"), row("lost", 0, msg_role="user", body="q"), row("sys", 0, msg_role="system", body="q")]


def test_conversation_over_many_tasks(spark):
    df = messages(spark, good_rows(400)).selectExpr("*", "1 as event", "2 as turn", "3 as session_key", "4 as instant")
    assert sorted(r.session_key for r in conversations.dropped(conversations.placed(df)).collect()) == ["lost", "sys"]
    rows = conversations.conversations(df).collect()
    assert sorted((r.session_key, r.turn) for r in rows) == [("hot", i) for i in range(400)] + [("tiny", 0), ("tiny", 1)]
    assert all(r.speaker == ("user" if r.turn % 2 == 0 else "assistant") for r in rows)
    assert conversations.conversations(df.limit(0)).count() == 0 and conversations.dropped(conversations.placed(df.limit(0))).count() == 0


def test_automaton():
    run = lambda *e: conversations.run(bytes(e))
    c = conversations
    assert run(c.SYSTEM, c.PROMPT, c.SYSTEM, c.REPLY) == c.GOOD
    assert run(c.PROMPT, c.RESULT, c.SILENT, c.REPLY, c.EMPTY, c.RESULT) == c.GOOD
    for bad in ([], [c.REPLY], [c.PROMPT], [c.PROMPT, c.PROMPT, c.REPLY], [c.PROMPT, c.REPLY, c.PROMPT], [c.PROMPT, c.NO_ROLE, c.REPLY], [c.EMPTY, c.PROMPT, c.REPLY], [c.PROMPT, c.SILENT]):
        assert run(*bad) != c.GOOD
    assert run(c.EMPTY_PROMPT, c.REPLY) == c.GOOD


def brute_runs(seqs):
    out = []
    for key, events in seqs.items():
        for _, g in itertools.groupby(events, key=lambda e: e[0]):
            g = list(g)
            if len(g) >= 3:
                out.append((key, g[0][1], sum(x[2] for x in g), len(g)))
    return sorted(out)


def test_runs_of_calls_equal_brute_force(spark):
    rows = random_messages(7) + [{"session_id": "long", "src_path": "/long.jsonl", "line_no": i, "msg_role": "assistant", "content_id": "x", "tool_name": "Read", "tool_input": f'{{"p": {i}}}', "ts_text": None} for i in range(900)]
    for i, r in enumerate(rows):
        r["row_id"] = i
    full = lambda s: bool(s and s.strip(" ​"))
    near = lambda s: re.sub(r"[\s0-9]", "", s or "").lower()
    seqs = {
        k: [((r["tool_name"].strip().lower(), near(r["tool_input"])), r["row_id"], 1) for r in rs if r["msg_role"] == "assistant" and full(r["content_id"]) and full(r["tool_name"])] for k, rs in ordered(rows)[0].items()
    }
    found = repeats.runs(repeats.calls(messages(spark, rows)), ["instant", "src_path", "line_no"])
    assert sorted((r.session_key, r.first_row_id, r.occurrences, r.n_rows) for r in found.collect()) == brute_runs(seqs)
    shown = {r.session_key: r for r in repeats.collapsed(found.selectExpr("*", "'x' as seq_table")).where("session_key = 'long'").collect()}
    assert sorted(shown["long"].also_at) == list(range(1, 900)) and shown["long"].duration_s is None
    lean = repeats.runs(repeats.calls(messages(spark, rows)), ["instant", "src_path", "line_no"], positions=False)
    assert sorted((r.session_key, r.first_row_id, r.n_rows) for r in lean.collect()) == [(k, f, n) for k, f, _, n in brute_runs(seqs)]


def test_runs_of_findings(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["s", "S ", "t", None]), rng.choice(["r", None]), "t", rng.choice(["E 1", "e22", None, ""]), rng.choice([None, 1, 4]), rng.choice([None, T0, T0 + dt.timedelta(seconds=i)]), 5) for i in range(600)]
    df = spark.createDataFrame(rows, "finding_id long, session_id string, rule_id string, title string, evidence string, occurrences int, seen_at timestamp, event_index int").selectExpr("*", "1 as digest", "2 as us")
    seqs = {}
    for i, s, r, t, e, n, at, _ in sorted(rows, key=lambda x: (x[6] is not None, x[6] or T0, x[0])):
        if s:
            seqs.setdefault(s.strip().lower(), []).append(((r, t, re.sub(r"[\s0-9]", "", e or "").lower()), i, n or 1))
    found = repeats.runs(repeats.sightings(df), ["us", "row_id"])
    assert sorted((r.session_key, r.first_row_id, r.occurrences, r.n_rows) for r in found.collect()) == brute_runs(seqs)
    assert repeats.runs(repeats.sightings(df.limit(0)), ["us", "row_id"]).count() == 0


def test_symbols_skip_surrogates():
    import numpy as np

    text = repeats.symbols(np.arange(600_000) % 70_000)
    assert len(text) == 600_000 and len(set(text)) == 70_000 and repeats.spans("aabbb") == [(0, 2), (2, 5)]


def test_equal_deliveries_give_one_turn(spark):
    row = {"session_id": "s", "src_path": "/s.jsonl", "ts_text": "2025-01-01T00:00:00Z", "ingest_ts": T0}
    ask, answer = row | {"line_no": 0, "msg_role": "user", "body": "q"}, row | {"line_no": 1, "msg_role": "assistant", "body": "a"}
    for ids in ({"row_id": None}, {"row_id": 7}):
        rows = [ask | ids, ask | ids, answer | {"row_id": 8}, answer | {"row_id": 8, "ingest_ts": T0 - dt.timedelta(days=1), "body": "older"}]
        got = conversations.conversations(messages(spark, rows)).collect()
        assert sorted((r.turn, r.speaker, r.body) for r in got) == [(0, "user", "q"), (1, "assistant", "a")]
    nowhere = [r | {"line_no": None, "ts_text": None} for r in (ask, answer)]
    assert conversations.conversations(messages(spark, nowhere)).count() == 0
