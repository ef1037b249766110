"""Hosts named in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from castellan.functions.lexers import schemeless_hosts
from castellan.rules import catalog as C


def _clean(token: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.substring_index(F.substring_index(token, "@", -1), "/", 1), ":", 1)))


def url_hosts(text: Column) -> Column:
    """Hosts of http and https URLs, in order, each once."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(C.java(C.HOST_URL)), 1), _clean), lambda h: h != ""))


def is_external(h: Column) -> Column:
    """False for this machine, .local names and private IPv4 ranges."""
    parts = F.split(h, r"\.")
    four = (F.size(parts) == 4) & h.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    a, b = F.get(parts, F.lit(0)).try_cast("long"), F.get(parts, F.lit(1)).try_cast("long")
    private = four & ((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)))
    return ~(h.isin("localhost", "0.0.0.0", "::1") | h.startswith("127.") | h.endswith(".local") | F.coalesce(private, F.lit(False)))


def bare_host_text(text: Column) -> Column:
    """The text where it names a contacting tool, else null: only these need the lexer."""
    return F.when(text.rlike(r"(?i)(?:^|\s)(?:curl|wget|nc|ncat|httpie|http)(?:\.exe)?[;|&]*\s"), text)


def external_hosts(text: Column) -> Column:
    """External hosts: those of URLs first, then those given to a tool without a scheme."""
    every = F.concat(url_hosts(text), F.coalesce(schemeless_hosts(bare_host_text(text)), F.array().cast("array<string>")))
    return F.filter(F.array_distinct(every), is_external)
