"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted r times (target tokens of the source / its tokens).
All take the whole part of r; the fraction is rounded by pivotal steps: two documents
with fractional probabilities trade token mass, up or down at odds that keep both
expectations, until one of them is 0 or 1.  A step never changes the tokens of a source,
so its total misses the target by less than one document.

Documents are rounded in salted buckets of a source; each bucket leaves at most one
fractional document, and these residuals go up a reduction tree of groups of bounded
size.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castellan.functions.text import trim_blanks
from castellan.llm.bpe import DEFAULT_VOCABULARY
from castellan.llm.tokens import with_token_counts
from castellan.operators.tables import cut

#: Documents that one rounding task holds, and residuals that one tree node combines.
BUCKET_ROWS = 50_000
FAN_IN = 1_000
_NEAR = 1e-9


def pivotal(items: Iterable[tuple[int, int, float]], seed: str) -> tuple[dict[int, int], tuple[int, int, float] | None]:
    """Rounds (row, size, probability) items: ({row: 0 or 1}, the one item left fractional).

    Sizes must be positive.  The expected value of every result is its probability, and
    the sum of size x value plus that of the item left equals the sum at the start.
    """
    rng = random.Random(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big"))
    out: dict[int, int] = {}
    held: tuple[int, int, float] | None = None
    for row, size, p in items:
        if p <= _NEAR or p >= 1 - _NEAR:
            out[row] = int(p > 0.5)
            continue
        if held is None:
            held = (row, size, p)
            continue
        a, size_a, p_a = held
        up = min((1 - p_a) * size_a, p * size)
        down = min(p_a * size_a, (1 - p) * size)
        move = up if rng.random() * (up + down) < down else -down
        p_a, p = p_a + move / size_a, p - move / size
        held = None
        for one in ((a, size_a, p_a), (row, size, p)):
            if one[2] <= _NEAR or one[2] >= 1 - _NEAR:
                out[one[0]] = int(one[2] > 0.5)
            else:
                held = one
    return out, held


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, float]:
    """Copies wanted of each document of a source, for the largest mix that max_repeats
    allows.  A source with a positive share but no tokens makes the mix empty."""
    shares = [(s, w, m) for s, w, m in targets if w > 0]
    size = min((m * totals.get(s, 0) / w for s, w, m in shares), default=0.0)
    return {s: min(float(m), size * w / totals[s]) if totals.get(s) else 0.0 for s, w, m in shares}


def mix(documents: DataFrame, mix_targets: DataFrame, seed: int = 0, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every document in the mix.

    Sources match without case and outer blanks; documents of no or another source, and
    those without tokens, are not in it.  Target rows with a null or a share that is not
    positive are ignored; of repeated sources shares add up and the least cap holds.
    Repeated and null doc_ids are rounded one by one.  No document is used more than max_repeats
    times.
    """
    named = mix_targets.select(F.lower(trim_blanks(F.col("source"))).alias("source"), "target_share", "max_repeats")
    # a hand-written list, held on the driver whole
    targets = named.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("m")).collect()
    wanted = [(t.source, t.w, t.m) for t in targets]
    docs = documents.select("doc_id", F.lower(trim_blanks(F.col("source"))).alias("source"), F.xxhash64("doc_id", "text").alias("_name"), "text").where(F.col("source").isin([s for s, _, _ in wanted]))
    sized = cut(with_token_counts(docs, vocabulary=vocabulary).where("n_tokens > 0").withColumn("_row", F.monotonically_increasing_id()))
    totals = {r.source: r for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    copies = plan({s: r.t for s, r in totals.items()}, wanted)
    whole = {s: int(r + _NEAR) for s, r in copies.items()}
    rest = {s: max(0.0, r - whole[s]) for s, r in copies.items()}
    buckets = {s: -(-r.n // BUCKET_ROWS) for s, r in totals.items()}

    def pick(values: dict, kind: str):
        pairs = [F.lit(x) for s in totals for x in (s, values.get(s, 0))]
        return F.create_map(*pairs)[F.col("source")].cast(kind) if pairs else F.lit(0).cast(kind)

    # equal rows are spread by their place once there are too many of them for one bucket
    many = sized.groupBy("_name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BUCKET_ROWS).select(F.col("_name").alias("_many"), F.ceil(F.col("_n") / BUCKET_ROWS).alias("_parts"))
    sized = sized.join(many, F.col("_name") == F.col("_many"), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_row"), "_parts"), F.lit(0).cast("long")))
    level = sized.select(
        "doc_id", "source", "n_tokens", pick(whole, "int").alias("base"), pick(rest, "double").alias("p"),
        F.pmod(F.xxhash64("_name", "_salt", F.lit(seed)), F.greatest(pick(buckets, "long"), F.lit(1).cast("long"))).alias("bucket"),
    )
    schema = "doc_id long, source string, n_tokens long, base int, p double, bucket long, last boolean"

    def round_bucket(depth: int):
        def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            # large documents first: the one left over is the likeliest to be small
            rows = rows.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
            out, left = pivotal(zip(rows.index, rows["n_tokens"], rows["p"]), f"{seed}/{depth}/{key}")
            rows["p"] = [float(out[i]) if i in out else left[2] for i in rows.index]
            rows["last"] = [i not in out for i in rows.index]
            return rows[["doc_id", "source", "n_tokens", "base", "p", "bucket", "last"]]

        return work

    done: DataFrame | None = None
    most = max(buckets.values(), default=1)
    depth = 0
    while True:
        rounded = cut(level.groupBy("source", "bucket").applyInPandas(round_bucket(depth), schema))
        fixed = rounded.where("not last")
        done = fixed if done is None else done.unionByName(fixed)
        level = rounded.where("last").drop("last").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        depth += 1
        if most <= 1:
            break
        most = -(-most // FAN_IN)
    # what is left at the root, one document a source at most: the nearer whole number
    final = done.unionByName(rounded.where("last").withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)))
    return final.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Target and actual share of every target source, with its documents, copies and tokens."""
    used = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")
    )
    named = mix_targets.select(F.lower(trim_blanks(F.col("source"))).alias("source"), "target_share", "max_repeats")
    wanted = named.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    total = used.agg(F.sum("tokens").alias("_total"))
    return (
        wanted.join(F.broadcast(used), "source", "left")  # at most one row a target
        .join(F.broadcast(total), F.lit(True))  # one row
        .select(
            "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("_total")).alias("actual_share"), "max_repeats",
            *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "most_copies", "tokens")),
        )
    )


def checks(mixed: DataFrame, mix_targets: DataFrame, sized: DataFrame) -> DataFrame:
    """(source, within_cap, share_met, as_large_as_possible) of every target source.

    ``sized`` has the source and n_tokens of all documents.  A share is met if the source's
    tokens miss it by less than its largest document (and the one whose rounding is left
    over); the mix is as large as possible if some source is used up to its cap.
    """
    named = F.lower(trim_blanks(F.col("source")))
    have = sized.groupBy(named.alias("source")).agg(F.sum("n_tokens").alias("_have"), F.max("n_tokens").alias("_largest"))
    rows = shares(mixed, mix_targets).join(F.broadcast(have), "source", "left")  # at most one row a target
    total = rows.agg(F.sum("tokens").alias("_all"), F.sum("_largest").alias("_slack"), F.max(F.col("tokens") + F.col("_largest") >= F.col("max_repeats") * F.col("_have")).alias("_full"))
    return rows.join(F.broadcast(total), F.lit(True)).select(  # one row
        "source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"),
        (F.abs(F.col("tokens") - F.col("target_share") * F.col("_all")) <= F.col("_largest") + F.col("target_share") * F.col("_slack")).alias("share_met"), F.col("_full").alias("as_large_as_possible"),
    )
