"""Exact deduplication with a split for heavy hitters (DataFrame functions only).

A Misra-Gries summary (Spark's approx_top_k keeps such counters) finds digests that may be frequent. Their exact
counts are then taken, and the verified winners, at most MAX_HEAVY rows, are broadcast and settle their copies
on the map side. All other digests, none of which can hold more than a small share of the rows, are shuffled.

Cases: a null text counts as empty; rows without doc_id rank below all others; of rows that repeat both doc_id
and text one stays; an empty table gives an empty result; columns named like ours are overwritten in the decisions
and kept in `keep_first`'s output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.staging import keep_rows, stage

MAX_HEAVY = 1000
TRACKED = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = stage(docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("text_sha256"), F.monotonically_increasing_id().alias("_row")), "digests")
    found = keyed.agg(F.expr(f"approx_top_k(text_sha256, {MAX_HEAVY}, {TRACKED})").alias("top"))
    maybe = found.select(F.explode("top").alias("x")).where("x.count > 1").select(F.col("x.item").alias("text_sha256"))
    winner = F.max(F.struct("doc_id", "_row")).alias("best")
    heavy = stage(keyed.join(F.broadcast(maybe), "text_sha256", "left_semi").groupBy("text_sha256").agg(winner, F.count(F.lit(1)).alias("group_size")), "heavy")  # MAX_HEAVY rows at most
    marked = keyed.join(F.broadcast(heavy), "text_sha256", "left")
    settled = marked.where(F.col("group_size").isNotNull())
    group = Window.partitionBy("text_sha256")
    rest = keyed.join(F.broadcast(heavy), "text_sha256", "left_anti").withColumns({"best": F.max(F.struct("doc_id", "_row")).over(group), "group_size": F.count(F.lit(1)).over(group)})
    return settled.unionByName(rest).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("best._row")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs; of the texts only those of dropped and repeated rows are moved, and none if these are few."""
    judged = decide(docs, doc_id, text).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key"), F.col("kept").alias("keep"), F.lit(False).alias("always"))
    return keep_rows(docs, F.col(doc_id), digest(F.col(text)), judged)
