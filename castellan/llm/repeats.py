"""Repeated consecutive events as runs, by a regular expression over symbol strings.

Each distinct event of a task becomes one Unicode code point; the symbols of an entity,
in order, form a string in which a backreference finds every run.  Spans map back to rows
and times.  The first and last run of a task may go on in its neighbours; these, at most
two a task, are joined afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castellan.functions.text import near_form, session_key, trim_blanks
from castellan.operators.messages import instant_of, is_call, kept_rows, role, with_instants
from castellan.operators.ordering import in_order
from castellan.operators.tables import cut

LEAST = 3
_RUN = re.compile(r"(.)\1*", re.DOTALL)
#: Code points that symbols take; a string is cut before it needs more.
_FIRST, _SKIP, _LAST = 0x100, 0xD800, 0x10FFFF
CHUNK_ROWS = 500_000

RUN = (
    "session_key string, task int, nth int, border boolean, digest binary, first_row_id long, last_row_id long, "
    "n_rows long, occurrences long, first_us long, last_us long, positions array<long>"
)


def symbols(codes: np.ndarray) -> str:
    """One character for each of fewer than a million small codes."""
    points = codes.astype(np.uint32) + _FIRST
    points[points >= _SKIP] += 0x800
    return points.tobytes().decode("utf-32-le")


def spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text)]


def digest(*parts: Column) -> Column:
    """128-bit name of an event; parts can't run into each other."""
    return F.unhex(F.md5(F.concat_ws("\x00", *(F.coalesce(F.length(p).cast("string"), F.lit("-")) for p in parts), *(F.coalesce(p, F.lit("")) for p in parts))))


def _find(least: int, with_positions: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), 0
        held: list | None = None  # the run that may go on
        first = True
        done: list[list] = []

        def close(run: list, border: bool) -> None:
            nonlocal nth
            if border or run[4] >= least:
                done.append([run[0], task, nth, border, *run[1:]])
                nth += 1

        def table() -> pa.RecordBatch:
            rows, done[:] = list(done), []
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), *[pa.int64()] * 6, pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in RUN.split(", ")])

        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK_ROWS):
                b = whole.slice(lo, CHUNK_ROWS)
                keys = b.column(0).dictionary_encode()
                name = b.column(1).dictionary_encode()
                key_code = keys.indices.to_numpy(zero_copy_only=False)
                code = name.indices.to_numpy(zero_copy_only=False)
                ids, counts, us, pos = (b.column(i).to_pylist() for i in (2, 3, 4, 5))
                begin = np.flatnonzero(np.r_[True, key_code[1:] != key_code[:-1]]).tolist()
                for a, e in zip(begin, [*begin[1:], b.num_rows]):
                    key = keys.dictionary[int(key_code[a])].as_py()
                    for s, t in spans(symbols(code[a:e])):
                        s, t = a + s, a + t
                        sign = name.dictionary[int(code[s])].as_py()
                        if held is not None and held[0] == key and held[1] == sign:
                            held[3], held[4], held[5] = ids[t - 1], held[4] + t - s, held[5] + sum(counts[s:t])
                            held[7] = us[t - 1] if us[t - 1] is not None else held[7]
                            if with_positions:
                                held[8].extend(pos[s:t])
                            continue
                        if held is not None:
                            close(held, first)
                            first = False
                        held = [key, sign, ids[s], ids[t - 1], t - s, sum(counts[s:t]), us[s], us[t - 1], pos[s:t] if with_positions else []]
            yield table()
        if held is not None:
            close(held, True)
        yield table()

    return work


def _join(least: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        """Joins the border runs of one key: equal neighbours in successive places."""
        out: list[dict] = []
        for r in rows.sort_values(["task", "nth"]).to_dict("records"):
            last = out[-1] if out else None
            if last is not None and last["digest"] == r["digest"] and r["nth"] == 0 and last["end_open"]:
                last["last_row_id"], last["last_us"] = r["last_row_id"], r["last_us"]
                last["n_rows"] += r["n_rows"]
                last["occurrences"] += r["occurrences"]
                last["positions"] = [*last["positions"], *r["positions"]]
                last["end_open"] = r["tail"]
            else:
                out.append(r | {"end_open": r["tail"]})
        df = pd.DataFrame(out).drop(columns=["end_open", "tail"])
        return df[df["n_rows"] >= least]

    return work


def runs(events: DataFrame, order: list[str], least: int = LEAST, positions: bool = True) -> DataFrame:
    """Runs of at least ``least`` rows of equal digest within a session_key.

    ``events``: session_key, digest, row_id, occurrences, us, position and the order
    columns.  A null time has no part in a duration.  Without ``positions`` memory is
    bounded however long a run is; with them, a run's row holds all of its positions.
    """
    ordered = in_order(events, "session_key", *order).select("session_key", "digest", "row_id", "occurrences", "us", "position")
    found = cut(ordered.mapInArrow(_find(least, positions), RUN))
    # the last border run of a task is its tail; the first may be the same one
    tails = found.where("border").groupBy("task").agg(F.max("nth").alias("_tail")).withColumnRenamed("task", "_task")
    border = found.where("border").join(F.broadcast(tails), F.col("task") == F.col("_task")).withColumn("tail", F.col("nth") == F.col("_tail")).drop("_task", "_tail")
    joined = border.groupBy("session_key").applyInPandas(_join(least), RUN)
    return found.where("not border").unionByName(joined)


def calls(messages: DataFrame) -> DataFrame:
    """Calls of every session as events: tool name without case and outer blanks, input
    without ASCII case, white space and digits."""
    rows = messages.withColumn("_role", role())
    call = F.coalesce(is_call(F.col("_role")), F.lit(False))
    name = digest(F.lower(trim_blanks(F.col("tool_name"))), near_form(F.col("tool_input")))
    kept = with_instants(kept_rows(rows, F.when(call, name).alias("digest"), instant_of()).drop("ingest_ts"))
    return kept.where("digest is not null").select(
        "session_key", "digest", "row_id", F.lit(1).cast("long").alias("occurrences"), F.col("instant").alias("us"), F.col("line_no").cast("long").alias("position"), "instant", "src_path", "line_no"
    )


def sightings(findings: DataFrame) -> DataFrame:
    """Findings as events.  Rows that name no session have none; null rule_id and title
    equal only null ones; a null evidence counts as empty, null occurrences as 1."""
    return findings.select(
        session_key(F.col("session_id")).alias("session_key"),
        digest(F.col("rule_id"), F.col("title"), near_form(F.col("evidence"))).alias("digest"),
        F.col("finding_id").alias("row_id"),
        F.coalesce(F.col("occurrences"), F.lit(1)).cast("long").alias("occurrences"),
        F.unix_micros("seen_at").alias("us"),
        F.col("event_index").cast("long").alias("position"),
    ).where("session_key is not null")


def all_runs(messages: DataFrame, findings: DataFrame, positions: bool = True) -> DataFrame:
    ours = runs(calls(messages), ["instant", "src_path", "line_no"], positions=positions).withColumn("seq_table", F.lit("session_messages"))
    theirs = runs(sightings(findings), ["us", "row_id"], positions=positions).withColumn("seq_table", F.lit("findings"))
    return ours.unionByName(theirs)


def collapsed(found: DataFrame) -> DataFrame:
    """One row per run: count, the other positions, first and last time, duration."""
    return found.select(
        "seq_table", "session_key", "first_row_id", "last_row_id", "n_rows", "occurrences",
        F.slice("positions", 2, F.size("positions")).alias("also_at"),
        F.timestamp_micros("first_us").alias("first_at"), F.timestamp_micros("last_us").alias("last_at"),
        ((F.col("last_us") - F.col("first_us")) / 1e6).alias("duration_s"),
    )
