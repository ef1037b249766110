import datetime as dt
import re
import unicodedata

from pyspark.sql import functions as F

from castellan.functions.datetimes import instant_micros, is_datetime
from castellan.functions.text import BLANKS, WHITE_SPACE, near_form, not_blank, session_key, trim_blanks


def test_white_space_is_the_unicode_property():
    every = {chr(c) for c in range(0x110000) if chr(c).isspace()} - set("\x1c\x1d\x1e\x1f")
    assert set(WHITE_SPACE) == every
    assert {unicodedata.category(c) for c in BLANKS} <= {"Zs", "Zl", "Zp", "Cc", "Cf"}


def test_blanks_and_keys(spark):
    rows = [(None, None), ("", "/a/b.x.jsonl"), (" ​", "/a/​.jsonl"), ("﻿Ab-1　", "/q"), (None, "name"), ("x", None)]
    df = spark.createDataFrame(rows, "s string, p string").select(not_blank(F.col("s")), trim_blanks(F.col("s")), session_key(F.col("s"), F.col("p")))
    assert [tuple(r) for r in df.collect()] == [
        (False, None, None), (False, "", "b"), (False, "", None), (True, "Ab-1", "ab-1"), (False, None, "name"), (True, "x", "x"),
    ]


def test_near_form(spark):
    texts = [None, "", "A1 b C\n9", "ÄÖ x0", "é" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(near_form(F.col("t")))
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    assert [r[0] for r in df.collect()] == [re.sub(r"[\s0-9]", "", (t or "").translate(lower)) for t in texts]


def test_datetimes(spark):
    good = ["2025-02-28T23:59:59Z", "2025-01-13 19:33:18.5+05:30", "2024-02-29T00:00:00.123456789-08:00"]
    bad = ["", "2025-02-29T00:00:00Z", "2025-01-01T24:00:00Z", "2025-01-01  00:00:00Z", "2025-01-01T00:00:60Z", "2025-01-01T00:00Z", "2025-01-01T00:00:00", "2025-01-01T00:00:00+0100", "2025-01-01T00:00:00Z\n", "٢٠٢٥-01-01T00:00:00Z", "2025-13-01T00:00:00Z"]
    assert all(map(is_datetime, good)) and not any(map(is_datetime, bad))
    got = [r[0] for r in spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string").select(instant_micros(F.col("t"))).collect()]

    def micros(t):
        t = re.sub(r"(\.\d{6})\d+", r"\1", t)
        return int((dt.datetime.fromisoformat(t) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))

    assert got == [micros(t) for t in good] + [None] * (len(bad) + 1)
