"""Stupid-backoff language-model scores, computed relationally.

Texts are taken in chunks, a few for each partition of the table. A chunk's distinct n-grams of every order, with their counts in it, are
partitioned by hash; there the count table sums each n-gram over all chunks, and what occurs more than once in the corpus goes back, joined, to the
chunks that have it. Each chunk's texts, compressed, meet these counts by a co-group, where n-grams are looked up and the logarithms summed for each document.

A document is scored by the counts of all other documents: of an n-gram's count and its context's count its own occurrences are taken off. An n-gram
seen elsewhere scores c(context word) / c(context); any other backs off to alpha times the score of the next shorter one. The last
is c(word) / N, a word that isn't seen elsewhere counted once. At a text's start contexts are as long as there are words, without a penalty.

A frequent n-gram has one row for each chunk, whatever share of the texts holds it, so no key is hot.

The table is read twice and must fall into the same partitions both times, as tables of files do; a chunk whose words differ raises an error.

Cases: words are runs of [^\\x20\\x09-\\x0D] with A-Z lower-cased; a null text or one without words has n_tokens 0 and a null score;
rows that repeat are each scored (and counted, each as the other's elsewhere); an empty table gives no rows; other columns aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.kernels import LOWER, buffers, mix, slices, span_hashes, words
from ferrule.llm.staging import text_batches

CHUNK_BYTES = 1 << 25
_WORDS, _SUM = 0, 1  # keys under which a chunk counts its words and a sum of their hashes


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """A chunk's number and its texts in slices; the rows of a partition (column part) fall into the same ones whenever it's read."""
    held, size, number = [], 0, 0
    for whole in batches:
        for b in slices(whole, "text"):
            held.append(b)
            size += b.column("text").nbytes
            if size >= CHUNK_BYTES:
                yield b.column("part")[0].as_py() << 20 | number, held
                held, size, number = [], 0, number + 1
    if held:
        yield held[0].column("part")[0].as_py() << 20 | number, held


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    return span_hashes(data, starts, ends), row


def _grams(h: np.ndarray, row: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the key of the n-gram that ends at each word, and whether it lies in one text."""
    out = []
    for n in range(1, order + 1):
        key, inside = np.full(len(h), n, np.uint64), np.arange(len(h)) >= n - 1
        for k in range(n - 1, -1, -1):
            back = np.arange(len(h)) - k
            back[back < 0] = 0
            key = mix(key + h[back] * np.uint64(2 * k + 3))
            inside &= row[back] == row
        out.append((np.maximum(key, np.uint64(2)), inside))
    return out


def counted(named: DataFrame, order: int, bits: int) -> DataFrame:
    """bucket, chunk, keys and cs: every distinct n-gram of every chunk with its count, in arrays by the first `bits` bits of the key, its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, parts in _chunks(batches):
            keys, total, check = [np.zeros(0, np.uint64)], 0, 0
            for b in parts:
                h, row = _hashes(*buffers(b.column("text")))
                keys += [key[inside] for key, inside in _grams(h, row, order)]
                total, check = total + len(h), check + int(mix(h).sum(dtype=np.uint64))
            parts.clear()  # the texts aren't needed any more
            key = np.concatenate(keys)
            keys.clear()
            key.sort()
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])) if len(key) else [])
            c = np.concatenate(([total, int(check) & 0x7FFFFFFF], np.diff(np.append(first, len(key))))).astype(np.int32)
            key = np.concatenate((np.array([_WORDS, _SUM], np.uint64), key[first]))
            del first
            edges = np.searchsorted(key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            bucket = np.flatnonzero(np.diff(np.append(edges, len(key))))
            cuts = edges[bucket]
            for at in range(0, len(cuts), 256):
                some = cuts[at : at + 256]
                end = cuts[at + 256] if at + 256 < len(cuts) else len(key)
                offsets = pa.array(np.append(some, end) - some[0], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[some[0] : end])) for x in (key.view(np.int64), c)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at : at + 256]), pa.array(np.full(len(some), chunk, np.int64)), *lists], ["bucket", "chunk", "keys", "cs"])
            del key, c
            pa.default_memory_pool().release_unused()

    return named.mapInArrow(run, "bucket long, chunk long, keys array<long>, cs array<int>")


def packed(named: DataFrame) -> DataFrame:
    """chunk, ids, sizes and the compressed texts, a row for each slice."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(named.schema["doc_id"].dataType)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("texts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, parts in _chunks(batches):
            for b in parts:
                data, offsets = buffers(b.column("text"))
                one = pa.array([0, b.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(one, x) for x in (b.column("doc_id"), pa.array(np.diff(offsets)))]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *lists, pa.array([pa.compress(data.tobytes(), "zstd", asbytes=True)], pa.binary())], schema.names)

    return named.mapInArrow(run, schema)


def _own(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each key occurs in its row."""
    at, n = np.unique(mix(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)[1:]
    return n[at]


def score(docs: DataFrame, order: int = 2, alpha: float = 0.4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_score (sum of natural logarithms), and mean_log_score."""
    text_batches(docs.sparkSession)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.spark_partition_id().cast("long").alias("part"))
    bits = max(10, (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    each = counted(named, order, bits).repartition("bucket").select("bucket", "chunk", F.inline(F.arrays_zip("keys", "cs"))).toDF("bucket", "chunk", "key", "c")
    summed = each.withColumn("total", F.sum("c").over(Window.partitionBy("bucket", "key"))).where(f"total > 1 or key in ({_WORDS}, {_SUM})")
    own = [F.max(F.when(F.col("key") == k, F.col("c"))).alias(n) for k, n in ((_WORDS, "words"), (_SUM, "sum"))]
    # all of a bucket lies in one partition, so nothing moves before the arrays go back to their chunks
    seen = summed.groupBy("bucket", "chunk").agg(F.collect_list("key").alias("keys"), F.collect_list("total").alias("totals"), *own).drop("bucket")
    schema = T.StructType([named.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("log_score", T.DoubleType())])

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        keys, total = (counts[c].combine_chunks().flatten().to_numpy() for c in ("keys", "totals"))
        sort = np.argsort(keys.view(np.uint64))
        keys, total = keys.view(np.uint64)[sort], total[sort]
        del sort
        told = [pc.max(counts[c]).as_py() for c in ("words", "sum")]
        every, n_words, check, out = int(total[0]), 0, np.uint64(0), []
        for r in range(texts.num_rows):
            sizes = texts["sizes"][r].values.to_numpy()
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            data = np.frombuffer(pa.decompress(texts["texts"][r].as_py(), int(offsets[-1]), "zstd") if offsets[-1] else b"", np.uint8)
            h, row = _hashes(data, offsets)
            n_words, check = n_words + len(h), check + int(mix(h).sum(dtype=np.uint64))
            n = np.bincount(row, minlength=len(sizes))
            before, value = None, None
            for size, (key, inside) in enumerate(_grams(h, row, order), 1):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                rest = np.where(keys[at] == key, total[at], 1) - _own(np.where(inside, key, np.uint64(0)), row)
                if size == 1:
                    value = np.log(np.maximum(rest, 1) / np.maximum(every - n, 1)[row])
                else:
                    context = np.concatenate((np.ones(1), before[:-1])) if len(h) else before
                    known = inside & (rest > 0)
                    value = np.where(known, np.log(np.maximum(rest, 1) / np.maximum(context, 1)), value + np.where(inside, np.log(alpha), 0.0))
                before = rest
            sums = np.bincount(row, value, len(sizes))
            out.append(pa.table([texts["ids"][r].values, pa.array(n.astype(np.int64)), pa.array(sums, mask=n == 0)], schema.names))
        if told != [n_words, int(check) & 0x7FFFFFFF]:
            raise RuntimeError("the table's partitions changed between two reads; write it once and score what was written")
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    scored = packed(named).groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInArrow(run, schema)
    return scored.withColumn("mean_log_score", F.col("log_score") / F.col("n_tokens"))
