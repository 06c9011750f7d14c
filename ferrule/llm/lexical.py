"""Ranked lexical search by windowed bucket scoring.

The corpus is read once for a block of items: each document gives its length and, of the block's terms, those it holds with their counts.
These postings are staged; document frequencies and lengths come from them. They are then dealt out by windows of WINDOW doc_ids, so that a window's scores fit a
core's first cache. A window's postings are sorted by term, each with its impact computed once. For each item the task traverses its terms' postings,
scatter-adds the impacts into the window's array of buckets, joins the terms' occupancy bitsets to know which buckets were touched, and harvests
those above the item's threshold into a heap of k. A task's heaps are all that leaves it; the final ranks are taken from them, in two steps.

Items are taken in blocks of about BLOCK_TERMS terms (a term is sent to the tasks, documents never are), so any number of items is served; each block reads the documents once.

Cases: a null or empty text has no terms, counts in no statistic and is never found; an item without terms, or whose terms no document holds, gives no rows; rows with
one item_id are one item that has all their terms; rows with one doc_id are documents of their own, and may both be found; a null doc_id is ranked after
others of its score, a null item_id is an item; a window with more rows than buckets (ids that repeat, null ids) is worked off in several arrays; empty tables give no rows;
other columns aren't used.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.kernels import slices, terms
from ferrule.llm.staging import stage, text_batches

WINDOW = 4096
BLOCK_TERMS = 200_000
#: Bytes between terms: ASCII other than digits and letters.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item and term, each once."""
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(PATTERN), F.lit(0))
    return items.select(F.col(item_id).alias("item"), F.explode(found).alias("term")).distinct()


def postings(docs: DataFrame, wanted: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms in the whole text), and of the wanted terms those that it holds, by number, with their counts; for every document with a term."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(wanted, pa.large_string())
        for whole in batches:
            for b in slices(whole, "text"):
                found, row = terms(b.column("text"), BETWEEN)
                n = np.bincount(row, minlength=b.num_rows)
                at = pc.index_in(found, known)
                hit = at.is_valid().to_numpy(zero_copy_only=False)
                key, tf = np.unique(row[hit] * len(wanted) + at.drop_null().to_numpy(), return_counts=True)
                bounds = np.searchsorted(key, np.arange(b.num_rows + 1) * len(wanted)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in ((key % max(1, len(wanted))).astype(np.int32), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *lists], schema.names).filter(pa.array(n > 0))

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def length_norm(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """20 * (100 - 50 + (50 * n * docs) div total) in integers, beyond 64 bits where the product needs it."""
    wide = n.astype(object) if len(n) and int(n.max()) * 50 * docs >= 2**63 else n
    return 20 * (50 + (50 * wide * docs) // total)


class _Window:
    """Postings of the documents of one array of buckets, sorted by term: impacts, buckets and an occupancy bitset for each term."""

    def __init__(self, ids: pa.Array, n: np.ndarray, lens: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, total: int, window: int):
        self.ids, self.size = ids, len(ids)
        slot = np.repeat(np.arange(self.size), lens)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + length_norm(n, docs, total)[slot]))
        order = np.argsort(term, kind="stable")
        self.slot, self.impact = slot[order], impact[order].astype(np.int64)
        self.terms, first = np.unique(term[order], return_index=True)
        self.ends = np.append(first, len(order))
        touched = np.zeros((len(self.terms), window), bool)
        touched[np.repeat(np.arange(len(self.terms)), np.diff(self.ends)), self.slot] = True
        self.bits = np.packbits(touched, axis=1)

    def harvest(self, buckets: np.ndarray, wanted: np.ndarray, k: int, heap: list) -> None:
        """Adds up the wanted terms' impacts and puts what is among the k best into the heap."""
        at = np.searchsorted(self.terms, wanted)
        at = at[np.append(self.terms, -1)[at] == wanted]
        if not len(at):
            return
        for t in at:
            span = slice(self.ends[t], self.ends[t + 1])
            buckets[self.slot[span]] += self.impact[span]  # a term has one posting a document
        touched = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(self.bits[at], axis=0)))
        score = buckets[touched]
        buckets[touched] = 0
        above = score > 0 if len(heap) < k else score >= max(1, heap[0][0])
        touched, score = touched[above], score[above]
        for i in np.lexsort((touched, -score))[:k]:
            one = self.ids[touched[i]].as_py()
            entry = (int(score[i]), one is not None, 0 if one is None else -one)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                break


def _windows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The sorted rows of each window in turn, `most` at a time."""

    def together(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held)
        lists = [t.column(c).combine_chunks() for c in ("terms", "tfs")]
        lens = pc.list_value_length(lists[0]).to_numpy()
        return t.column("doc_id").combine_chunks(), t.column("n").to_numpy(), lens, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()

    held, rows, window = [], 0, None
    for b in batches:
        marks = b.column("window").fill_null(np.iinfo(np.int64).min).to_numpy()
        cuts = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), len(marks)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            while i < j:
                if held and (marks[i] != window or rows == most):
                    yield together(held)
                    held, rows = [], 0
                window, to = marks[i], min(j, i + most - rows)
                held.append(b.slice(i, to - i))
                rows += to - i
                i = to
    if held:
        yield together(held)


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id")]


def best(found: DataFrame, items: list[set[int]], weight: list[int], docs: int, total: int, k: int, window: int) -> DataFrame:
    """at (an item's number), doc_id, score: the k best of each item in each task's windows. items: of each, its terms' numbers."""
    wanted = [np.array(sorted(x), np.int64) for x in items]
    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, buckets, w = [[] for _ in wanted], np.zeros(window, np.int64), np.array(weight, np.int64)
        for ids, n, lens, term, tf in _windows(batches, window):
            one = _Window(ids, n, lens, term, tf, w, docs, total, window)
            for heap, own in zip(heaps, wanted, strict=True):
                one.harvest(buckets, own, k, heap)
        for at, heap in enumerate(heaps):
            if heap:
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(heap), pa.int32()), pa.array([-d if known else None for _, known, d in heap], pa.int64()), pa.array([s for s, _, _ in heap], pa.int64())], schema.names)

    dealt = found.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("window", F.expr(f"(doc_id - pmod(doc_id, {window})) div {window}"))
    return dealt.repartition("window").sortWithinPartitions(F.asc_nulls_last("window"), F.asc_nulls_last("doc_id")).mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    text_batches(spark)
    asked = stage(item_terms(items, item_id, item_text), "asked")
    blocks = max(1, -(-asked.count() // block_terms))
    parts = []
    for block in range(blocks):
        pairs = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        if not pairs:
            continue
        ids, terms_of, number = {}, [], {}
        for item, term in pairs:
            at = ids.setdefault(item, len(ids))
            if at == len(terms_of):
                terms_of.append(set())
            terms_of[at].add(number.setdefault(term, len(number)))
        found = stage(postings(docs, list(number), doc_id, text), "postings")
        n_docs, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(number))]
        kept = best(found, terms_of, weight, n_docs, total, k, window)
        names = spark.createDataFrame([(at, item) for item, at in ids.items()], T.StructType([T.StructField("at", T.IntegerType()), T.StructField("item_id", items.schema[item_id].dataType)]))
        some = kept.withColumn("part", F.spark_partition_id() % 64).withColumn("r", F.row_number().over(Window.partitionBy("at", "part").orderBy(*_order()))).where(F.col("r") <= k)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(*_order()))).where(F.col("rank") <= k)
        parts.append(ranked.join(F.broadcast(names), "at").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    return reduce(DataFrame.unionByName, parts)
