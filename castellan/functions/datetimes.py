"""Strict date-time texts: a real date, ``T`` or one blank, a real time with seconds and
optional fraction, then ``Z`` or an offset."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = (
    r"([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
    r"(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})"
)
_PY = re.compile(_FORM, re.ASCII)


def is_datetime(text: str) -> bool:
    m = _PY.fullmatch(text)
    if not m:
        return False
    try:
        dt.date(int(m[1]), int(m[2]), int(m[3]))
    except ValueError:
        return False
    return True


def instant_micros(c: Column) -> Column:
    """Microseconds since the epoch of a strict date-time; null for anything else.

    The offset is subtracted by hand, so the session time zone has no part in it.
    Fractions beyond microseconds are cut.
    """
    ok = c.rlike("^" + _FORM + r"\z")
    day = F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))
    day = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")
    part = lambda at: F.substring(c, at, 2).cast("long")
    frac = F.regexp_extract(c, r"\.([0-9]{1,6})", 1)
    zone = F.right(c, F.lit(6))
    minutes = F.substring(zone, 2, 2).cast("long") * 60 + F.substring(zone, 5, 2).cast("long")
    offset = F.when(c.endswith("Z"), F.lit(0).cast("long")).when(zone.startswith("-"), -minutes).otherwise(minutes)
    seconds = day * 86400 + part(12) * 3600 + part(15) * 60 + part(18) - offset * 60
    return F.when(ok, seconds * 1_000_000 + F.rpad(frac, 6, "0").cast("long"))
