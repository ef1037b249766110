"""Column builders for the text conventions shared by all operators.

*Blank* means null or made only of Unicode white space and zero-width characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: Zero-width characters that count as blank (fixed values).
ZERO_WIDTH = "\u200b\ufeff"
BLANKS = WHITE_SPACE + ZERO_WIDTH

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"


def trim_blanks(c: Column) -> Column:
    """``c`` without outer blanks; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def not_blank(c: Column) -> Column:
    """True where ``c`` has a visible character; false for null and blank."""
    return F.coalesce(F.length(trim_blanks(c)) > 0, F.lit(False))


def near_form(c: Column) -> Column:
    """Text without ASCII letter case, white space and digits; null counts as empty.

    Two texts are near if these forms are equal.  ``translate`` keeps the work in one
    pass inside whole-stage code generation.
    """
    drop = WHITE_SPACE + _DIGITS
    return F.translate(F.coalesce(c, F.lit("")), _UPPER + drop, _UPPER.lower())


def session_key(session_id: Column, src_path: Column | None = None) -> Column:
    """Normalised session id; if null or blank, the file name up to its first dot.

    Null if neither names a session.
    """
    own = F.nullif(F.lower(trim_blanks(session_id)), F.lit(""))
    if src_path is None:
        return own
    name = F.substring_index(F.substring_index(src_path, "/", -1), ".", 1)
    return F.coalesce(own, F.when(not_blank(name), name))
