import random

from castellan.operators.messages import instant_of, kept_rows, with_instants
from castellan.operators.ordering import numbered
from tests.helpers import messages


def test_numbered_equals_row_number_for_hot_and_null_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(50), i) for i in range(3000)]
    got = numbered(spark.createDataFrame(rows, "k string, o int, i int"), "k", "o", "i").collect()
    by = {}
    for k, o, i in sorted(rows, key=lambda r: r[1:]):
        by.setdefault(k, []).append(i)
    assert sorted((r.k or "", r.seq, r.i) for r in got) == sorted((k or "", n, i) for k, v in by.items() for n, i in enumerate(v))
    assert numbered(spark.createDataFrame([], "k string, o int"), "k", "o").count() == 0


def test_latest_delivery_counts(spark):
    import datetime as dt

    at = dt.datetime(2025, 1, 1)
    rows = [
        {"row_id": 1, "session_id": "S", "src_path": "/f.jsonl", "line_no": 0, "ingest_ts": at, "body": "old"},
        {"row_id": 2, "session_id": " s​", "src_path": "/f.jsonl", "line_no": 0, "ingest_ts": at, "body": "new"},
        {"row_id": 3, "session_id": "s", "src_path": "/f.jsonl", "line_no": 0, "ingest_ts": None, "body": "no time"},
        {"row_id": 4, "session_id": None, "src_path": None, "line_no": 0, "body": "nowhere"},
        {"row_id": 5, "session_id": "s", "src_path": None, "line_no": None, "body": "null place"},
    ]
    df = messages(spark, rows).selectExpr("*", "1 as session_key", "2 as _block", "3 as _rank")  # clashing names
    got = kept_rows(df, df["body"].alias("body")).collect()
    assert sorted((r.session_key, r.row_id) for r in got) == [("s", 2), ("s", 5)]


def test_instants_are_filled_within_a_file_over_blocks(spark, monkeypatch):
    from castellan.operators import messages as m

    monkeypatch.setattr(m, "BLOCK_LINES", 3)
    rng = random.Random(2)
    rows, want = [], {}
    for f in ("/a.jsonl", "/b.jsonl"):
        last = None
        for n in range(40):
            t = rng.choice([None, "", "unknown", f"2025-01-01T00:00:{n:02d}Z"]) if n > 4 else None
            last = 1735689600_000000 + n * 1_000_000 if t and t[0] == "2" else last
            want[f, n] = last
            rows.append({"session_id": "s", "src_path": f, "line_no": n, "ts_text": t})
    rng.shuffle(rows)
    kept = kept_rows(messages(spark, rows), instant_of())
    assert {(r.src_path, r.line_no): r.instant for r in with_instants(kept).collect()} == want
