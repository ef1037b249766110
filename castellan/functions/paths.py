"""Path algebra as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from castellan.functions.binding import let
from castellan.rules.catalog import DEVICES, NO_HOME, SCRATCH, SENSITIVE


def posix_path_column(c: Column) -> Column:
    """Windows drives and shares as absolute POSIX paths, anything else as it is."""
    tail = F.replace(F.regexp_replace(F.substr(c, F.lit(3)), r"^[\\/]+", ""), F.lit("\\"), F.lit("/"))
    share = F.concat(F.lit("//"), F.replace(F.substr(c, F.lit(3)), F.lit("\\"), F.lit("/")))
    return F.when(c.rlike(r"^[A-Za-z]:[\\/]"), F.concat(F.lit("/"), F.lower(F.left(c, F.lit(1))), F.lit("/"), tail)).when(c.startswith("\\\\"), share).otherwise(c)


def normal(p: Column) -> Column:
    """POSIX normal form of an absolute path; exactly two leading slashes stay."""
    empty = F.lit(None).cast("array<string>")
    parts = F.aggregate(
        F.filter(F.split(p, "/"), lambda x: (x != "") & (x != ".")),
        F.coalesce(empty, F.array().cast("array<string>")),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)),
    )
    lead = F.when(p.startswith("//") & ~p.startswith("///"), "//").otherwise("/")
    return F.concat(lead, F.array_join(parts, "/"))


def resolved(raw: Column, cwd: Column, home: Column) -> Column:
    """Absolute normal path; null for an empty one and for a relative one without a cwd."""
    full = F.when(raw == "~", home).when(raw.startswith("~/"), F.concat(home, F.substr(raw, F.lit(2)))).otherwise(raw)
    joined = lambda x: F.when(x.startswith("/"), x).when(cwd != "", F.concat(cwd, F.when(cwd.endswith("/"), "").otherwise("/"), x))
    ready = lambda x: F.when(x.startswith("/"), normal(x)).otherwise(x)
    return let(F.when(raw != "", full), lambda x: let(joined(x), ready))


def under(p: Column, root: Column) -> Column:
    return (p == root) | p.startswith(F.concat(root, F.lit("/")))


def is_scratch(p: Column) -> Column:
    return p.rlike(SCRATCH)


def is_sensitive(p: Column) -> Column:
    return p.rlike(SENSITIVE)


def is_device(p: Column) -> Column:
    return p.isin(*DEVICES)


def shown(p: Column) -> Column:
    """A path below the stand-in for an unknown home is shown with a tilde."""
    tilde = F.concat(F.lit("~"), F.substr(p, F.lit(len(NO_HOME) + 1)), F.lit(" (this transcript never recorded a home directory)"))
    return F.when(under(p, F.lit(NO_HOME)), tilde).otherwise(p)
