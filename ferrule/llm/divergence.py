"""How far the sources of a language differ in their words, over distinct columns of counts.

Words are counted by language and source, first within each slice of texts, then by Spark. A language's term has a sparse vector of its counts by source; terms
with an identical vector differ in nothing that the audit computes, so each distinct vector is kept once with its multiplicity. Every pair of sources
is evaluated on the distinct vectors alone, in blocks of a matrix, each distance times the multiplicity; tasks return sums by pair. For the terms that a source uses more
than its language does, vectors are ranked first, each by its least term: the k best terms lie in the k best vectors, and only these are joined with their terms again.

All arithmetic is exact: a share is 1 + floor(10^9 (count + 5) / (N + 5 V)), by long division where 64 bits don't hold the product (up to N = 9e15).

A group's row of pairs is as long as its language has sources, so the result of pairs grows with their square. Groups are sent to tasks in blocks of languages, MAX_BROADCAST groups at
most (a single language with more makes a block of its own).

Cases: a null text, lang or source is an empty one; a group without terms is a group like any other, with N = 0; a language without kept terms has pairs of value 0
and no terms; rows that repeat each count; a language with one source has no pairs; an empty table gives no rows; other columns aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.kernels import slices, terms
from ferrule.llm.staging import MAX_BROADCAST, bounded, stage, text_batches

SCALE, SMOOTH = 1_000_000_000, 5
CELLS, STRIP = 1 << 22, 1024
#: Bytes between terms: ASCII other than letters.
BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents of the group that hold it). docs: lang, source, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", most=1 << 23):
                found, row = terms(b.column("text"), BETWEEN)
                if not len(found):
                    continue
                lang, source, term = (x.dictionary_encode() for x in (b.column("lang"), b.column("source"), found))
                width = len(term.dictionary)
                group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                key, n = np.unique(row * width + term.indices.to_numpy(), return_counts=True)
                key, at = np.unique(group[key // width] * width + key % width, return_inverse=True)
                in_docs = np.bincount(at)
                n = np.bincount(at, weights=n).astype(np.int64)
                g = key // width
                picked = [lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary))), term.dictionary.take(pa.array(key % width)).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*picked, pa.array(n), pa.array(in_docs)], ["lang", "source", "term", "n", "docs"])

    made = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vectors(counted: DataFrame, least: int) -> DataFrame:
    """lang, term and vec, its counts by source, for terms in at least so many documents of the language."""
    by_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec"))
    return by_term.where(F.col("docs") >= least).select("lang", "term", "vec")


def share(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / size); count + SMOOTH is at most size."""
    x = count + SMOOTH
    if not x.size or int(x.max()) < 2**63 // SCALE:
        return 1 + SCALE * x // size
    q, x = x // size, x % size
    for _ in range(3):
        q, x = 1000 * q + 1000 * x // size, 1000 * x % size
    return 1 + q


class _Language:
    """Sums over vectors of |p_a - p_b| times their multiplicity, for all pairs of a language's sources."""

    def __init__(self, lang: str, sources: list[str], sizes: list[int]):
        self.lang, self.number, self.size = lang, {s: i for i, s in enumerate(sources)}, np.array(sizes, np.int64)
        self.sums = np.zeros((len(sources),) * 2, np.int64) if len(sources) <= STRIP else None
        self.held: list[tuple[list, int]] = []

    def add(self, vec: list[dict], m: int) -> Iterator[tuple[int, np.ndarray]]:
        self.held.append((vec, m))
        if len(self.held) * len(self.number) >= CELLS:
            yield from self.evaluate()

    def evaluate(self) -> Iterator[tuple[int, np.ndarray]]:
        """Adds up what is held; beyond STRIP sources gives strips of the sums, with their first row, else nothing."""
        count = np.zeros((len(self.held), len(self.number)), np.int64)
        for i, (vec, _) in enumerate(self.held):
            for x in vec:
                count[i, self.number[x["source"]]] = x["n"]
        p, m = share(count, self.size), np.array([m for _, m in self.held], np.int64)
        self.held = []
        for first in range(0, len(self.number), STRIP):
            sums = np.array([m @ np.abs(p - p[:, a : a + 1]) for a in range(first, min(first + STRIP, len(self.number)))])
            if self.sums is None:
                yield first, sums
            else:
                self.sums += sums


def distances(distinct: DataFrame, groups: list) -> DataFrame:
    """lang, source, item, value: sums over the given distinct vectors (lang, vec, m), partial ones by task. groups: lang, source, size."""
    found: dict[str, list[tuple[str, int]]] = {}
    for lang, source, size in groups:
        found.setdefault(lang, []).append((source, size))

    def rows(one: _Language, first: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = np.array(list(one.number), object)
        for a, line in enumerate(sums, first):
            other = np.arange(len(names)) != a
            n = int(other.sum())
            yield pa.RecordBatch.from_arrays([pa.array([one.lang] * n, pa.string()), pa.array([names[a]] * n, pa.string()), pa.array(names[other], pa.string()), pa.array(line[other])], ["lang", "source", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: dict[str, _Language] = {}
        for b in batches:
            for lang, vec, m in zip(*(b.column(c).to_pylist() for c in ("lang", "vec", "m")), strict=True):
                if lang not in languages:
                    languages[lang] = _Language(lang, *zip(*found[lang], strict=True))
                for first, sums in languages[lang].add(vec, m):
                    yield from rows(languages[lang], first, sums)
        for one in languages.values():
            for first, sums in one.evaluate():
                yield from rows(one, first, sums)
            if one.sums is not None:
                yield from rows(one, 0, one.sums)

    return distinct.select("lang", "vec", "m").mapInArrow(run, "lang string, source string, item string, value long")


def _share(count: str, size: str) -> Column:
    return F.expr(f"1 + {SCALE} * cast({count} + {SMOOTH} as decimal(20, 0)) div {size}")


def audit(docs: DataFrame, least: int = 30, k: int = 50, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    text_batches(docs.sparkSession)
    named = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    kept = stage(vectors(counts(named), least), "vectors")
    vec = kept.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("m"), F.min("term").alias("first"))
    distinct = stage(vec, "distinct")
    sums = distinct.select("lang", "m", F.explode("vec").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum(F.col("m") * F.col("x.n")).alias("n"))
    sizes = distinct.groupBy("lang").agg(F.sum("m").alias("v"))
    groups = stage(
        named.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), (SMOOTH * F.coalesce("v", F.lit(0))).alias("smooth")),
        "groups",
    )
    listed = groups.count()

    blocks, parts = max(1, -(-listed // MAX_BROADCAST)), []
    block = F.pmod(F.xxhash64("lang"), F.lit(blocks))
    for i in range(blocks):
        own = groups.where(block == i).select("lang", "source", F.expr("n + smooth")).collect()
        if own:
            parts.append(distances(distinct.where(block == i), own))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = groups.select("lang", "source").join(bounded(groups.select("lang", F.col("source").alias("item")), listed), "lang").where("source <> item")
    if parts:
        total = reduce(DataFrame.unionByName, parts).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        pairs = pairs.join(total, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    else:
        pairs = pairs.withColumn("value", F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    of_lang = bounded(groups.groupBy("lang").agg((F.sum("n") + F.max("smooth")).alias("lang_size")), listed)
    each = distinct.select("lang", "vec", "first", F.expr("aggregate(vec, 0L, (s, x) -> s + x.n)").alias("lang_n"), F.explode("vec").alias("x")).select("*", F.col("x.source").alias("source"), F.col("x.n").alias("own"))
    sized = each.join(bounded(groups.select("lang", "source", F.expr("n + smooth").alias("size")), listed), ["lang", "source"]).join(of_lang, "lang")
    over = sized.withColumn("value", _share("own", "size") - _share("lang_n", "lang_size")).where("value > 0")
    top = over.withColumn("r", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "first"))).where(F.col("r") <= k).select("lang", "vec", "source", "value")
    some = kept.withColumn("r", F.row_number().over(Window.partitionBy("lang", "vec").orderBy("term"))).where(F.col("r") <= k).select("lang", "vec", F.col("term").alias("item"))
    ranked = top.join(some, ["lang", "vec"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank")).where(F.col("rank") <= k)
    return pairs.unionByName(ranked)
