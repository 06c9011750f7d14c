"""The retrieval service for many questions at once, in one plan: both legs with and without the court's filter, their union fused, boosted, diversified and capped.

The union is always taken over both filters: what a filtered leg finds may come twice, and a row's rank in its leg is then the last of its places in the sorted union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import terms
from ferrule.operators import search

# Candidates of each leg, fusion constant, rank of what a leg lacks, and boosts.
VECTORS, KEYWORDS, CONSTANT, MISSING = 320, 140, 60, 1_000_000
NEAR, APEX, RECENT, TOPICAL, MORE = 0.20, 0.15, 0.05, 0.10, 0.05
DIGITS = 12


def leg(found: DataFrame, score: str, apex: Column, most: int) -> DataFrame:
    """q, doc, score and rank of the union of a leg's best rows with and without the filter. found: q, doc, the score and what `apex` reads."""
    rounded = found.withColumn("score", F.round(score, DIGITS)).withColumn("apex", apex)
    order = [F.desc("score"), "doc"]
    cut = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") <= most).select("q", "doc", "score")
    both = cut(rounded).unionByName(cut(rounded.where("apex")))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).groupBy("q", "doc").agg(F.max("score").alias("score"), F.max("r").alias("rank"))


def fused(near: DataFrame, words: DataFrame, docs: DataFrame, questions: DataFrame, year: int) -> DataFrame:
    """q, doc, source, score of every candidate. near, words: legs; docs: doc, snippet, source, apex, decided; questions: q, text."""
    top = near.withColumn("vec_norm", F.coalesce(F.try_divide(F.col("score"), F.max("score").over(Window.partitionBy("q"))), F.lit(0.0))).select("q", "doc", "vec_norm", F.col("rank").alias("ra"))
    both = top.join(words.select("q", "doc", F.col("rank").alias("rb")), ["q", "doc"], "full_outer")
    part = lambda c: 1.0 / (CONSTANT + F.coalesce(F.col(c), F.lit(MISSING)))
    asked = questions.select("q", F.array_distinct(terms(F.col("text"))).alias("tokens")).join(words.select("q").distinct(), "q", "left_semi")  # words count only where the keyword leg finds something
    named = both.join(docs, "doc").join(asked, "q", "left")
    hits = F.size(F.filter(F.coalesce("tokens", F.expr("cast(array() as array<string>)")), lambda t: F.contains(F.lower("snippet"), t)))
    boost = F.when(F.col("apex"), APEX).otherwise(0.0) + F.when(year - F.year("decided") <= 10, RECENT).otherwise(0.0) + F.when(hits >= 1, TOPICAL).otherwise(0.0) + F.when(hits >= 2, MORE).otherwise(0.0)
    return named.select("q", "doc", "source", (part("ra") + part("rb") + NEAR * F.coalesce("vec_norm", F.lit(0.0)) + boost).alias("score"))


def diversified(scored: DataFrame, k: int, weight: float = 0.7, cap: int = 3) -> DataFrame:
    """q, doc, score, rank: of each question's 4 k best the k first by maximal marginal relevance, rows of one source being alike, `cap` of a source at most."""
    of = lambda *c: Window.partitionBy("q", *c)
    best = [F.desc(F.round("score", DIGITS)), "doc"]
    pool = scored.withColumn("n", F.row_number().over(of().orderBy(*best))).where(F.col("n") <= 4 * k)
    again = F.row_number().over(of("source").orderBy(*best)) > 1
    mmr = pool.withColumn("mmr", F.round(weight * F.col("score") - F.when(again, 1 - weight).otherwise(0.0), 9))
    order = [F.desc("mmr"), *best]
    picked = mmr.withColumn("n", F.row_number().over(of().orderBy(*order))).where(F.col("n") <= k)
    capped = picked.withColumn("nth", F.row_number().over(of("source").orderBy("n"))).where(F.col("nth") <= cap)
    return capped.withColumn("rank", F.row_number().over(of().orderBy("n"))).select("q", "doc", "score", "rank")


def retrieve(questions: DataFrame, vectors: DataFrame, ranked: DataFrame, docs: DataFrame, k: int, year: int) -> DataFrame:
    """questions: q, text, vector; vectors: doc, embedding; ranked: q, doc, score of the full-text leg; docs: doc, snippet, source, apex, decided."""
    flags = docs.select("doc", "apex")
    both = vectors.join(flags, "doc").select(F.col("doc").alias("vec_id"), "embedding", "apex")
    asked = questions.select(F.col("q").alias("q_id"), F.col("vector").alias("q"))
    every = search.nearest_each(both, asked, VECTORS).unionByName(search.nearest_each(both.where("apex"), asked, VECTORS)).select(F.col("q_id").alias("q"), F.col("vec_id").alias("doc"), "sim", "apex").distinct()
    near = leg(every, "sim", F.col("apex"), VECTORS)
    words = leg(ranked.join(flags, "doc"), "score", F.col("apex"), KEYWORDS)
    return diversified(fused(near, words, docs, questions, year), k)
