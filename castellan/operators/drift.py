"""Schemas that drift between files: a lifespan catalogue of every field per producer.

Records are JSON objects; a *stream* is a producer, its files are ordered by file_time.
Footer-like metadata (file, field path, spelling, JSON type) is taken from each record,
reduced per batch before it is shuffled, and folded into one row per file and path.
Starts and endings of a path are found with lag/lead over its files; names and types of
neighbouring files are compared the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castellan.functions import jsontext
from castellan.operators.ordering import numbered

#: Nothing below these paths is part of the schema: their keys are data.
OPAQUE = ("message.content.input",)

def alias_table(field_names: DataFrame) -> dict[str, str]:
    """field_name -> canonical_name; rows with a null are ignored, of several the least wins.
    A hand-written list: it is held on the driver and sent to the workers whole."""
    rows = field_names.where("field_name is not null and canonical_name is not null").groupBy("field_name").agg(F.min("canonical_name").alias("c"))
    return {r.field_name: r.c for r in rows.toLocalIterator()}


class Paths:
    """Canonical field paths of parsed records."""

    def __init__(self, aliases: dict[str, str], opaque: tuple[str, ...] = OPAQUE):
        self.aliases, self.opaque, self.names = aliases, frozenset(opaque), {}

    def canonical(self, name: str) -> str:
        got = self.names.get(name)
        if got is None:
            plain = name.lower().replace("_", "").replace("-", "")
            got = self.names[name] = self.aliases.get(plain, plain)
        return got

    def fields(self, record: object) -> Iterator[tuple[str, str, object, tuple]]:
        """(path, spelling, value, place) of every field, without recursion.  The place has
        an (array, index) for each array around the field."""
        todo: list[tuple[str, object, tuple]] = [("", record, ())]
        while todo:
            path, value, place = todo.pop()
            if isinstance(value, list):
                todo.extend((path, x, (*place, (value, i))) for i, x in reversed(list(enumerate(value))) if isinstance(x, (dict, list)))
            elif isinstance(value, dict):
                if path in self.opaque:
                    continue
                below = []
                for name, x in value.items():
                    at = f"{path}.{self.canonical(name)}" if path else self.canonical(name)
                    yield at, name, x, place
                    if isinstance(x, (dict, list)):
                        below.append((at, x, place))
                todo.extend(reversed(below))


def _parsed(text: str | None) -> object:
    """The record; null for a null and for what is no JSON text."""
    try:
        return jsontext.parse(text) if text else None
    except ValueError:
        return None


def _has_plain(value: object) -> bool:
    """Whether a list holds plain values, at any depth, that no field of its own stands for."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo.extend(v)
        elif v is not None and not isinstance(v, dict):
            return True
    return False


def field_sightings(records: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """One row per file, path, spelling and type, with the number of records, and of those
    in which the path is a list with plain values in it, and in which it lies in a list.

    A null, empty or unparsable record and one that is no object has no fields, but its
    file still counts: each batch also gives its files with a null path.  Type is null for
    a JSON null.  Reduced once per task batch and once more before the shuffle.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, kinds = Paths(aliases), jsontext.KINDS
        for b in batches:
            seen: dict[tuple, list[int]] = {}
            for stream, file_id, at, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                seen.setdefault((stream, file_id, at, None, None, None), [0, 0, 0])
                own: dict[tuple, tuple[bool, bool]] = {}
                for p, name, v, place in paths.fields(_parsed(text)):
                    k = (p, name, kinds.get(type(v)))
                    if k not in own or place or k[2] == "array":
                        plain, inside = own.get(k, (False, False))
                        own[k] = plain or k[2] == "array" and _has_plain(v), inside or bool(place)
                for k, flags in own.items():
                    n = seen.setdefault((stream, file_id, at, *k), [0, 0, 0])
                    for i, x in enumerate((1, *flags)):
                        n[i] += x
            rows = list(seen)
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))]
            counts = [pa.array([n[i] for n in seen.values()], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, *counts], names=["stream_name", "file_id", "file_us", "field_path", "spelling", "json_type", "records", "plain_lists", "in_lists"])

    source = records.select("stream_name", "file_id", F.unix_micros("file_time").alias("file_us"), "record")
    found = source.mapInArrow(look, "stream_name string, file_id long, file_us long, field_path string, spelling string, json_type string, records long, plain_lists long, in_lists long")
    return found.groupBy("stream_name", "file_id", "file_us", "field_path", "spelling", "json_type").agg(F.sum("records").alias("records"), F.sum("plain_lists").alias("plain_lists"), F.sum("in_lists").alias("in_lists"))


def lifespans(sightings: DataFrame) -> DataFrame:
    """Catalogue: one row per stream, file and path.

    ``file_no`` is the file's place in its stream (by file_us, then file_id); ``adjacent``
    says that the path was in the file just before; ``island`` numbers the unbroken runs
    of files that have it.
    """
    files = sightings.where("field_path is null").select("stream_name", "file_id", "file_us").distinct()
    # a stream of any number of files is numbered over many tasks
    files = numbered(files, "stream_name", "file_us", "file_id", name="_no").select(F.col("stream_name").alias("_s"), F.col("file_id").alias("_f"), (F.col("_no") + 1).cast("int").alias("file_no"))
    after = files.select(F.col("_s").alias("_s2"), (F.col("file_no") - 1).alias("_n2"), F.col("_f").alias("next_file"))
    files = files.join(after, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("file_no") == F.col("_n2")), "left").drop("_s2", "_n2")
    per_file = (
        sightings.where("field_path is not null")
        .groupBy("stream_name", "file_id", "field_path")
        .agg(
            F.array_sort(F.collect_set("spelling")).alias("spellings"),
            F.array_sort(F.collect_set("json_type")).alias("json_types"),
            F.max("records").alias("records"),
        )
    )
    own = Window.partitionBy("stream_name", "field_path").orderBy("file_no")
    return (
        per_file.join(files, F.col("stream_name").eqNullSafe(F.col("_s")) & F.col("file_id").eqNullSafe(F.col("_f")))
        .drop("_s", "_f")
        .withColumn("_before", F.lag("file_no").over(own))
        .withColumn("_after", F.lead("file_no").over(own))
        .withColumn("adjacent", F.coalesce(F.col("_before") == F.col("file_no") - 1, F.lit(False)))
        .withColumn("ends", F.coalesce(F.col("_after") != F.col("file_no") + 1, F.lit(True)) & F.col("next_file").isNotNull())
        .withColumn("was_spelled", F.lag("spellings").over(own))
        .withColumn("was_typed", F.lag("json_types").over(own))
        .withColumn("island", F.sum(F.when(F.col("adjacent"), 0).otherwise(1)).over(own))
        .drop("_before", "_after")
    )


def changes(catalogue: DataFrame) -> DataFrame:
    """file_id, field_path, change_kind of every file against the file before it, with the
    old and new spellings and types."""
    parent = F.when(F.instr("field_path", ".") > 0, F.regexp_replace("field_path", r"\.[^.]*\z", ""))
    c = catalogue
    detail = ["spellings", "json_types", "was_spelled", "was_typed"]
    none = F.lit(None).cast("array<string>")
    starts = c.where("not adjacent and file_no > 1").select(
        "stream_name", "file_no", "file_id", "field_path", F.lit("added").alias("change_kind"),
        "spellings", "json_types", none.alias("was_spelled"), none.alias("was_typed"),
    )
    stops = c.where("ends").select(
        "stream_name", (F.col("file_no") + 1).alias("file_no"), F.col("next_file").alias("file_id"), "field_path", F.lit("removed").alias("change_kind"),
        none.alias("spellings"), none.alias("json_types"), F.col("spellings").alias("was_spelled"), F.col("json_types").alias("was_typed"),
    )
    both = c.where("adjacent").select(F.col("stream_name").alias("_s"), F.col("file_no").alias("_n"), F.col("field_path").alias("_p"))
    edges = starts.unionByName(stops).withColumn("_parent", parent)
    held = edges.where("_parent is not null").join(
        both, F.col("stream_name").eqNullSafe(F.col("_s")) & (F.col("file_no") == F.col("_n")) & (F.col("_parent") == F.col("_p")), "left_semi"
    )
    same = c.where("adjacent")
    kinds = F.filter(
        F.array(
            F.when(F.col("spellings") != F.col("was_spelled"), "renamed"),
            F.when((F.col("json_types") != F.col("was_typed")) & (F.size("json_types") > 0) & (F.size("was_typed") > 0), "retyped"),
        ),
        lambda x: x.isNotNull(),
    )
    inner = same.select("stream_name", "file_no", "file_id", "field_path", F.explode(kinds).alias("change_kind"), *detail)
    out = ["stream_name", "file_no", "file_id", "field_path", "change_kind", *detail]
    return edges.where("_parent is null").select(out).unionByName(held.select(out)).unionByName(inner.select(out))


def casts(sightings: DataFrame) -> DataFrame:
    """One row per path over all streams: the types seen and the column type that holds
    them all (double, boolean or string; JSON text where types mix or nest, or lie in lists)."""
    kinds = F.array_sort(F.collect_set("json_type"))
    alike = F.when((F.size("json_types") == 1) & (F.col("in_lists") == 0), F.element_at("json_types", 1))
    return (
        sightings.where("field_path is not null")
        .groupBy("field_path")
        .agg(kinds.alias("json_types"), F.array_sort(F.collect_set("spelling")).alias("spellings"), F.sum("records").alias("records"), F.sum("plain_lists").alias("plain_lists"), F.sum("in_lists").alias("in_lists"))
        .withColumn("column_type", F.when(alike == "number", "double").when(alike == "boolean", "boolean").otherwise("string"))
    )


#: Field paths that get columns of their own, those of most records first; what lies beyond
#: is kept in one map column.
MAX_COLUMNS = 2000
OTHERS = "other_fields"


def _nested(found: list[tuple[tuple, object]]) -> list:
    """Values of one path below an array as a list shaped like that array: one entry per
    element, lists within lists, null where an element lacks the field."""
    outer = found[0][0][0][0]
    made: dict[int, list] = {id(outer): [None] * len(outer)}
    for place, value in found:
        for (array, i), (below, _) in zip(place, place[1:]):
            if id(below) not in made:
                made[id(below)] = made[id(array)][i] = [None] * len(below)
        array, i = place[-1]
        made[id(array)][i] = value
    return made[id(outer)]


def consistent_table(records: DataFrame, aliases: dict[str, str], plan: list[tuple[str, str]], others: bool = False) -> DataFrame:
    """Every record as one row: its keys, then one column per leaf path of ``plan``
    (path, column type); with ``others`` a map of every other plain value, by path.

    Paths below an array give the JSON text of a list shaped like the array, with null for
    elements that lack the field; of an array within such a list likewise.  Where spellings
    of one field meet in one object the last counts.  A null or unparsable record gives a
    row of nulls.  A record column is named by its path with ``__`` between names; one that
    clashes with another column gets ``__`` behind it.
    """
    wanted = [p for p, _ in plan]

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, at = Paths(aliases), {p: i for i, p in enumerate(wanted)}
        for b in batches:
            values: list[list] = [[None] * b.num_rows for _ in wanted]
            rest: list[dict] = [{} for _ in range(b.num_rows)]
            for row, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                lists: dict[str, list] = {}
                for p, _, v, place in paths.fields(_parsed(text)):
                    if p not in at and (not others or isinstance(v, dict) or isinstance(v, list) and not _has_plain(v)):
                        continue
                    if place:
                        lists.setdefault(p, []).append((place, v))
                    elif v is not None and p in at:
                        values[at[p]][row] = jsontext.shown(v)
                    elif v is not None:
                        rest[row][p] = jsontext.shown(v)
                for p, found in lists.items():
                    # the same path below several arrays: spellings of one name in one object
                    outer = found[-1][0][0][0]
                    text_ = jsontext.shown(_nested([x for x in found if x[0][0][0] is outer]))
                    if p in at:
                        values[at[p]][row] = text_
                    else:
                        rest[row][p] = text_
            cells = [pa.array(v, pa.string()) for v in values]
            if others:
                cells.append(pa.array([list(x.items()) for x in rest], pa.map_(pa.string(), pa.string())))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cells], names=[*b.schema.names[:-1], *(f"c{i}" for i in range(len(cells)))])

    keys = ["rec_id", "file_id", "stream_name", "file_name", "file_time", "arrived_at"]
    source = records.select(*keys, "record")
    kinds = ["string"] * len(wanted) + ["map<string,string>"] * others
    schema = ", ".join([*(f"{n} {t}" for n, t in source.select(*keys).dtypes), *(f"c{i} {t}" for i, t in enumerate(kinds))])
    taken = {*keys, OTHERS}
    names = []
    for p in wanted:
        name = p.replace(".", "__")
        while name in taken:
            name += "__"
        taken.add(name)
        names.append(name)
    typed = [F.expr(f"try_cast(c{i} as {kind})").alias(n) for i, ((_, kind), n) in enumerate(zip(plan, names))]
    rest = [F.col(f"c{len(wanted)}").alias(OTHERS)] if others else []
    return source.mapInArrow(flat, schema).select(*keys, *typed, *rest)


def table_plan(found: DataFrame) -> tuple[list[tuple[str, str]], bool]:
    """(path, column type) of every path that holds values of its own, in order, and whether
    there are more of them than columns.

    Those are paths without sub-paths, and those that are an object or list in some records
    but a plain value, or a list of some, in others.
    """
    parents = found.select(F.explode(F.array(F.regexp_extract("field_path", r"\A(.*)\.[^.]*\z", 1))).alias("_parent")).where("_parent <> ''").distinct()
    own = F.col("_parent").isNull() | F.arrays_overlap("json_types", F.array(*map(F.lit, ("string", "number", "boolean")))) | (F.col("plain_lists") > 0)
    leaves = found.join(parents, F.col("field_path") == F.col("_parent"), "left").where(own)
    rows = leaves.orderBy(F.desc("records"), "field_path").select("field_path", "column_type").limit(MAX_COLUMNS + 1).collect()
    return sorted((r.field_path, r.column_type) for r in rows[:MAX_COLUMNS]), len(rows) > MAX_COLUMNS


def values_per_path(records: DataFrame, aliases: dict[str, str], plan: list[tuple[str, str]]) -> DataFrame:
    """(field_path, records): the records that have a value in each column of the consistent
    table, before it is typed."""
    texts = consistent_table(records, aliases, [(p, "string") for p, _ in plan])
    columns = texts.columns[6:]
    sums = texts.agg(*(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(p).alias("field_path"), F.col(f"n{i}").alias("records")) for i, (p, _) in enumerate(plan)))).alias("x")).select("x.*")
