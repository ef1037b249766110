"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castellan.llm import conversations, mixing, repeats, secrets, splitting, tokens
from castellan.llm.queries_sql import SQL as _SQL
from castellan.operators.tables import cut
from castellan.plans.load import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.dropped(conversations.placed(table(spark, d, "session_messages")))


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "session_messages"))


def _runs(spark: SparkSession, d: str, positions: bool) -> DataFrame:
    return repeats.all_runs(table(spark, d, "session_messages"), table(spark, d, "findings"), positions)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, False).select("seq_table", "session_key", "first_row_id", "occurrences")


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    return repeats.collapsed(_runs(spark, d, True))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return secrets.texts({t: table(spark, d, t) for t in ("tool_results", "findings")})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.cases(_texts(spark, d)).select("src_table", "field_name", "row_key", "start_pos")


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redacted(_texts(spark, d))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """That masking changes nothing else: lengths, line ends, and every character that isn't
    an asterisk now stands where it stood."""
    texts = _texts(spark, d)
    key = ["src_table", "field_name", "row_key"]
    shape = lambda c: F.regexp_replace(c, r"[^\r\n]", ".")
    facts = lambda df, n: df.select(*key, F.length("text").alias(f"{n}_length"), F.md5(shape("text")).alias(f"{n}_lines"), F.col("text").alias(n))
    both = facts(texts, "before").join(facts(secrets.redacted(texts).drop("n_credentials"), "after"), key)
    same = secrets.differs_only_in_masks(F.col("before"), F.col("after"))
    return both.select(*key, (F.col("before_length") == F.col("after_length")).alias("same_length"), (F.col("before_lines") == F.col("after_lines")).alias("same_lines"), same.alias("same_rest"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts that come back from their ids."""
    return tokens.texts_of_ids(p8_ids(spark, d)).select("doc_id", F.md5("text").alias("text_md5"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mix(spark, d), table(spark, d, "mix_targets"))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of every source: that no cap is passed, that its tokens miss its share by less than a
    document, and that the mix is as large as the caps allow."""
    targets = table(spark, d, "mix_targets")
    return mixing.checks(cut(_mix(spark, d)), targets, tokens.with_token_counts(table(spark, d, "documents").select("source", "text")))


def p10_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of every document: that its pieces, without what they share, are its text in order,
    that each holds its limit and reaches beyond the one before; and that a text without
    pieces is within its limit."""
    return splitting.checks(table(spark, d, "documents"), table(spark, d, "chunk_limits"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "documents"), table(spark, d, "chunk_limits"))


QUERIES = {f.__name__: f for f in (p1_found, p1_conversations, p6_found, p6_runs, p7_found, p7_redacted, p7_kept, p8_ids, p8_round_trip, p9_mix, p9_shares, p9_checks, p10_pieces, p10_checks)}
SQL: dict[str, str] = dict(_SQL)
