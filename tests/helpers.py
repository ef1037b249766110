"""Small inputs for tests."""

import datetime as dt
import json

MESSAGES = (
    "row_id long, session_id string, src_path string, line_no int, event_type string, msg_role string, ts_text string, model_name string, content_id string, "
    "tool_name string, tool_input string, tool_use_id string, body string, cwd string, ingest_ts timestamp"
)
T0 = dt.datetime(2025, 1, 1)


def messages(spark, rows):
    """rows: dicts; missing fields are null, row_id and ingest_ts count up."""
    names = [x.split()[0] for x in MESSAGES.split(", ")]
    full = [{"row_id": i, "ingest_ts": T0 + dt.timedelta(seconds=i)} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], MESSAGES)


def call(command, name="Bash", cwd="/home/me/app", **fields):
    given = command if isinstance(command, dict) else {"command": command}
    return {"type": "assistant", "cwd": cwd, "message": {"role": "assistant", "content": [{"type": "tool_use", "id": fields.pop("id", "t1"), "name": name, "input": given}]}} | fields


def result(text, id="t1", cwd="/home/me/app", **fields):
    return {"type": "user", "cwd": cwd, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": id, "content": text}]}} | fields


def write(path, events):
    path.write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events) + "\n", encoding="utf-8")
    return str(path)
