"""Conversations rebuilt from message rows.

Rows are partitioned by conversation key with a secondary sort by place; a finite-state
automaton reads the events of each conversation and says which are broken, empty or
unanswered.  A conversation that reaches over several tasks is read piece by piece: a
piece is the map of the automaton's states that its events make, and the maps of a
conversation are composed in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castellan.functions.text import not_blank, session_key
from castellan.operators.messages import instant_of, is_call, kept_rows, role, with_instants
from castellan.operators.ordering import counted, in_order, with_numbers
from castellan.operators.tables import cut

# Events of the automaton
NO_ROLE, SYSTEM, PROMPT, EMPTY_PROMPT, RESULT, REPLY, SILENT, EMPTY = range(8)
# States: what came so far, times whether any content did; the last one is failure
START, IDLE, PENDING = 0, 1, 2
BAD = 6
STATES = 7


def _table() -> np.ndarray:
    """next[state, event]"""
    t = np.full((STATES, 8), BAD, np.uint8)
    for phase in (START, IDLE, PENDING):
        for filled in (0, 1):
            s = phase * 2 + filled
            stay = {SYSTEM: s}
            if phase != PENDING:
                stay |= {PROMPT: PENDING * 2 + 1, EMPTY_PROMPT: PENDING * 2 + filled}
            if phase != START:
                stay |= {RESULT: phase * 2 + 1, SILENT: phase * 2 + 1, EMPTY: s, REPLY: IDLE * 2 + 1}
            for event, to in stay.items():
                t[s, event] = to
    return t


NEXT = _table()
_ROWS = [bytes(r) for r in NEXT]
#: Events that are held before they are folded into the effect so far.
FOLD_EVENTS = 1_000_000
#: Conversations that end in this state stay.
GOOD = IDLE * 2 + 1


def run(events: bytes, state: int = START) -> int:
    rows = _ROWS
    for e in events:
        state = rows[state][e]
    return state


def event() -> F.Column:
    """Event of a kept row with _role, _body, _ref (non-blank body and tool_use_id), _call."""
    r = F.col("_role")
    return (
        F.when(r.isNull(), NO_ROLE).when(r == "system", SYSTEM)
        .when(r == "user", F.when(F.col("_ref"), RESULT).when(F.col("_body"), PROMPT).otherwise(EMPTY_PROMPT))
        .when(F.col("_call") | F.col("_body"), REPLY).when(F.col("_ref"), SILENT).otherwise(EMPTY)
    )


def placed(messages: DataFrame, *columns, ties: bool = False) -> DataFrame:
    """Kept rows with their event and instant."""
    rows = messages.withColumn("_role", role())
    facts = rows.withColumns({"_body": not_blank(F.col("body")), "_ref": not_blank(F.col("tool_use_id")), "_call": F.coalesce(is_call(F.col("_role")), F.lit(False))})
    kept = kept_rows(facts, event().cast("tinyint").alias("event"), instant_of(), *columns, ties=ties)
    return with_instants(kept.drop("ingest_ts"))


PIECE = "session_key string, piece int, effect binary, border boolean"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(session_key, piece, effect, reaches over a border) of each conversation in a task."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    key, events, first, so_far = None, bytearray(), True, bytes(range(STATES))
    out: list[tuple] = []

    def close(last: bool) -> None:
        nonlocal first
        if key is not None:
            border = first or last
            done = bytes(run(bytes(events), s) for s in so_far) if border else bytes([run(bytes(events), so_far[START])])
            out.append((key, pid, done, border))
            first = False

    def batch() -> pa.RecordBatch:
        rows, out[:] = list(out), []
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["session_key", "piece", "effect", "border"])

    for b in batches:
        if not b.num_rows:
            continue
        enc = b.column(0).dictionary_encode()
        code = enc.indices.to_numpy(zero_copy_only=False)
        symbols = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
        begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]).tolist()
        for a, e in zip(begin, [*begin[1:], b.num_rows]):
            own = enc.dictionary[int(code[a])].as_py()
            if own != key:
                close(False)
                key, events, so_far = own, bytearray(), bytes(range(STATES))
            events += symbols[a:e]
            if len(events) > FOLD_EVENTS:  # memory stays flat however long a conversation is
                so_far, events = bytes(run(bytes(events), s) for s in so_far), bytearray()
        yield batch()
    close(True)
    yield batch()


def final_states(events: DataFrame) -> DataFrame:
    """(session_key, state) of every conversation.

    Pieces at the border of a task are at most two a task; only they are grouped.
    """
    ordered = in_order(events.select("session_key", "instant", "src_path", "line_no", "event"), "session_key", "instant", "src_path", "line_no")
    parts = ordered.select("session_key", "event").mapInArrow(_pieces, PIECE)
    return _folded(parts)


def _folded(parts: DataFrame) -> DataFrame:
    """Composes the effects of a conversation in order.  A conversation has one row per
    task it reaches into, so the lists here are bounded by the number of tasks."""
    at = lambda e, s: F.conv(F.hex(F.substring(e, s + 1, F.lit(1))), 16, 10).cast("int")
    steps = F.array_sort(F.collect_list(F.struct("piece", "effect", "border")))
    return (
        parts.groupBy("session_key")
        .agg(steps.alias("_steps"))
        .select(
            "session_key",
            F.when(F.col("_steps")[0]["border"], F.aggregate("_steps", F.lit(START), lambda s, x: at(x["effect"], s)))
            .otherwise(at(F.col("_steps")[0]["effect"], F.lit(0)))
            .alias("state"),
        )
    )


def files_with_gaps(events: DataFrame) -> DataFrame:
    """session_key of files that lack a line_no between 0 and their greatest one."""
    blocks = events.groupBy("session_key", "src_path", "_block").agg(F.count("line_no").alias("_n"), F.max("line_no").alias("_top"), F.min("line_no").alias("_low"))
    files = blocks.groupBy("session_key", "src_path").agg(F.sum("_n").alias("_n"), F.max("_top").alias("_top"), F.min("_low").alias("_low"))
    return files.where("_n <> _top + 1 or _low <> 0").select("session_key")


def dropped(events: DataFrame) -> DataFrame:
    """Session keys of broken, empty and unanswered conversations."""
    bad = final_states(events).where(F.col("state") != GOOD).select("session_key")
    return bad.unionByName(files_with_gaps(events)).distinct()


#: What a row says, beside its place.
TEXTS = ("content_id", "tool_name", "tool_input", "tool_use_id", "body")


def _names(*columns: str) -> list:
    """128 bits that stand for the columns; nulls are values of their own."""
    facts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(i), *facts).alias(f"name{i}") for i in range(2)]


def conversations(messages: DataFrame) -> DataFrame:
    """Rows of the conversations that stay: session_key, turn (0-based, in order),
    speaker, instant, row_id, content_id, tool_name, tool_input, tool_use_id, body.

    Rows without a role can't occur here.  A null body stays null.  Rows are kept, ordered,
    judged and numbered by their keys alone; one join brings the texts of those that stay.
    Of deliveries that are equal in place, ingest_ts and row_id any one counts.  Extra
    columns of the input, whatever their names, have no part.
    """
    rows = placed(messages, F.col("_role").alias("speaker"), F.col("ingest_ts").alias("sent_at"), ties=True)
    order = ("session_key", "instant", "src_path", "line_no")
    ordered = counted(rows.select(*order, "event", "_block", "row_id", "speaker", "sent_at", "_tied"), *order)
    # tasks keep their rows and order, so the automaton reads them where they lie
    parts = cut(ordered.select("session_key", "event").mapInArrow(_pieces, PIECE))
    bad = _folded(parts).where(F.col("state") != GOOD).select("session_key").unionByName(files_with_gaps(ordered)).distinct()
    # a conversation leaves piece by piece, so a hot one is no single key of the join
    gone = ordered.groupBy("session_key", "_pid").agg(F.count(F.lit(1)).alias("_n")).join(bad, "session_key").select("session_key", "_pid")
    stay = with_numbers(ordered.join(gone, ["session_key", "_pid"], "left_anti"), "session_key", name="turn")
    left = stay.select("session_key", "turn", "speaker", "instant", "row_id", *_names("session_key", "src_path", "line_no", "sent_at"))
    key = session_key(F.col("session_id"), F.col("src_path")).alias("session_key")
    said = messages.select(key, "src_path", "line_no", "ingest_ts", F.col("row_id").alias("_id"), *TEXTS).where("session_key is not null")
    said = said.select("_id", *(n.alias(f"_{i}") for i, n in enumerate(_names("session_key", "src_path", "line_no", "ingest_ts"))), *TEXTS)
    same = F.col("row_id").eqNullSafe(F.col("_id")) & (F.col("name0") == F.col("_0")) & (F.col("name1") == F.col("_1"))
    out = left.join(said, same).select("session_key", "turn", "speaker", F.timestamp_micros("instant").alias("spoken_at"), "row_id", *TEXTS)
    # equal deliveries meet each other: only then is there anything to drop
    return out.dropDuplicates(["session_key", "turn"]) if not ordered.where("_tied").isEmpty() else out
