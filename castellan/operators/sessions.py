"""Per-session attributes and the link from results to calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castellan.functions.paths import posix_path_column
from castellan.rules import catalog as C


def tool_kind(c):
    n = F.lower(F.btrim(c, F.lit(" \t\n\r\x0b\x0c\xa0　")))
    out = F.when(n.startswith("mcp__"), "mcp")
    for name, kind in C.TOOL_KINDS.items():
        out = out.when(n == name, kind)
    return out.otherwise("other")


def first_string(v, *names: str):
    """First field of a variant that is a string with characters, else ''; numbers and
    objects don't pass for strings."""
    picks = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING", F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit(""))) for n in names]
    return F.coalesce(*picks, F.lit(""))


def calls(events: DataFrame) -> DataFrame:
    """Calls with their kind, in the order (event_index, block)."""
    return events.where("kind = 'call'").select(
        "session_key", "event_index", "block", "tool_name", tool_kind(F.col("tool_name")).alias("tool_kind"), "tool_use_id", "input_json", "cwd", "ts"
    )


def results(events: DataFrame) -> DataFrame:
    """Results with the tool of the last call that has their id; '' where there is none."""
    named = (
        events.where("kind = 'call' and tool_use_id <> ''")
        .groupBy(F.col("session_key").alias("_k"), F.col("tool_use_id").alias("_id"))
        .agg(F.max_by("tool_name", F.struct("event_index", "block")).alias("_tool"))
    )
    return (
        events.where("kind = 'result'")
        .select("session_key", "event_index", "block", "tool_use_id", "text", "truncated")
        .join(named, (F.col("session_key") == F.col("_k")) & (F.col("tool_use_id") == F.col("_id")), "left")
        .withColumn("tool_name", F.coalesce("_tool", F.lit("")))
        .drop("_k", "_id", "_tool")
    )


def majority_cwd(events: DataFrame) -> DataFrame:
    """(session_key, project_root): most frequent cwd, of equals the first seen."""
    per = events.where("kind = 'event' and cwd is not null").groupBy("session_key", "cwd").agg(F.count(F.lit(1)).alias("n"), F.min("event_index").alias("first"))
    return per.groupBy("session_key").agg(F.max_by("cwd", F.struct("n", -F.col("first"))).alias("project_root"))


def homes(events: DataFrame) -> DataFrame:
    """(session_key, home): home folder named by the busiest cwd, else by the first path of
    a call; sessions without either are left out."""
    home = lambda c: F.nullif(F.regexp_extract(c, C.HOME, 1), F.lit(""))
    cwds = events.where("kind = 'event' and cwd is not null").groupBy("session_key", "cwd").agg((-F.count(F.lit(1))).cast("long").alias("a"), F.min("event_index").cast("long").alias("b"))
    parsed = events.where("kind = 'call'").withColumn("_v", F.try_parse_json("input_json"))
    fields = F.array(*(F.try_variant_get("_v", f"$.{n}", "string") for n in C.PATH_FIELDS))
    named = parsed.select("session_key", F.col("event_index").cast("long").alias("a"), F.col("block").cast("long").alias("b"), F.posexplode(F.transform(fields, posix_path_column)).alias("c", "path"))
    found = (
        cwds.select("session_key", F.lit(0).alias("tier"), "a", "b", F.lit(0).alias("c"), home(F.col("cwd")).alias("home"))
        .unionByName(named.select("session_key", F.lit(1).alias("tier"), "a", "b", "c", home(F.col("path")).alias("home")))
        .where("home is not null")
    )
    return found.groupBy("session_key").agg(F.min_by("home", F.struct("tier", "a", "b", "c")).alias("home"))


def sessions(events: DataFrame, project_root: str | None = None) -> DataFrame:
    """One row per session with its counters, first and last time, root and home."""
    is_ = lambda k: F.col("kind") == k
    base = events.groupBy("session_key").agg(
        F.count_if(is_("event") | is_("skipped")).alias("event_count"),
        F.count_if(is_("skipped")).alias("skipped_lines"),
        F.count_if(is_("call")).alias("tool_call_count"),
        F.count_if(is_("result") & F.col("truncated")).alias("truncated_results"),
        F.min_by("ts", F.when(is_("event") & F.col("ts").isNotNull(), F.col("event_index"))).alias("first_ts"),
        F.max_by("ts", F.when(is_("event") & F.col("ts").isNotNull(), F.col("event_index"))).alias("last_ts"),
        F.max("event_index").alias("last_event"),
        F.min_by("session_id", F.when(is_("event") & F.col("session_id").isNotNull(), F.col("event_index"))).alias("_sid"),
    )
    stem = F.regexp_extract("session_key", r"([^/]*?)(?:\.[^./]*)?$", 1)
    out = base.join(majority_cwd(events), "session_key", "left").join(homes(events), "session_key", "left")
    root = F.lit(project_root) if project_root else F.coalesce("project_root", F.lit(""))
    return out.withColumns({"session_id": F.coalesce("_sid", stem), "project_root": root, "home": F.coalesce("home", F.lit(C.NO_HOME))}).drop("_sid")
