"""Concatenate and cut: documents' tokens, laid end to end, are cut into windows of a fixed length.

Pass 1 tokenises each partition and notes every document's place in it. The partitions' totals, summed up in order,
give each partition's place in the whole. Pass 2 cuts: a document that crosses a window's end gives one boundary
record for each window it lies in. Only the last window can be short, so at most one sequence has padding.

Tokens come from a `tokenizers` file. Texts are split where that vocabulary's splitting pattern always splits
(before a blank that is followed by a sign, between letters and punctuation, around single line ends), and the
ids of each different piece are kept by the task, so that a piece is encoded once. With `added`, literals of the file's added
tokens (such as <|endoftext|>) get their own ids, as the library gives by default; without it they are ordinary text.

Cases: a null or empty text gives only the end token; very long texts give many records; rows that repeat are packed
again; an empty table gives no records; other columns aren't used.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.kernels import buffers, slices, span_hashes
from ferrule.llm.staging import stage, text_batches

MAX_BROADCAST_PARTITIONS = 1_000_000
MAX_PIECES = 1_500_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_INK = np.zeros(256, bool)
_INK[33:127] = True
_INK[0xC3:0xE1] = _INK[0xE4:0xF0] = True  # lead bytes under which no character is white space


class PieceEncoder:
    """Ids of texts by a byte-level BPE of the `tokenizers` library, encoding each different piece once."""

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = json.loads(self.tokenizer.to_str())["added_tokens"]
        tokens = [x for x in tokens if added or not x["special"]]  # the switch only concerns special ones
        self.alone = all(not (x["single_word"] or x["lstrip"] or x["rstrip"]) for x in tokens)
        self.literal = re.compile(b"|".join(re.escape(x["content"].encode()) for x in sorted(tokens, key=lambda x: -len(x["content"])))) if tokens else None
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.raw, self.raw_at, self.raw_n = bytearray(), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of pieces: every text's start, and places where the pattern splits whatever stands around."""
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if len(data) > 1:
            b, after = data[:-1], data[1:].copy()
            inner = offsets[1:-1]
            after[inner[(inner > 0) & (inner < len(data))] - 1] = 0  # a text's last byte has nothing after it
            cut[:-2] |= (b == 32) & _INK[after]
            letter = _LETTER[b].copy()
            letter[1:] |= (data[:-2] == 0xC3) & (b[1:] != 0x97) & (b[1:] != 0xB7) & (b[1:] >= 0x80)
            mark = _MARK[after] | (after == 10)
            cut[1:-1] |= (letter & mark) | (_MARK[b] & (after == 10))
            single = (b[1:] == 10) & (letter | _MARK[b])[:-1] & (after[:-1] == 10)
            cut[2:-1] |= single & _INK[after[1:]]
        cut[len(data)] = False
        return np.flatnonzero(cut)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """bounds, with each added token's literal as a piece of its own; if tokens take their surroundings in, a text with one isn't cut."""
        raw = data.tobytes() if self.literal else b""
        if not self.literal or not self.literal.search(raw):
            return self.bounds(data, offsets)
        spans = []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found = [m.span() for m in self.literal.finditer(raw, s, e)]
            spans += found if self.alone or not found else [(s, e)]
        if not spans:
            return self.bounds(data, offsets)
        at = np.array(spans, np.int64)
        starts = self.bounds(data, np.sort(np.concatenate((offsets, at.ravel()))))
        k = np.searchsorted(at[:, 0], starts, "left") - 1  # the last literal that opens before
        return starts[(k < 0) | (starts >= at[k, 1])]

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        texts = [x.decode() for x in pieces]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for e in ids for x in e), np.uint32, int(n.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(len(flat), self.used), np.uint32)))
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        raw_n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw_at = len(self.raw) + np.cumsum(raw_n) - raw_n
        self.raw += b"".join(pieces)
        keys = np.concatenate((self.keys, hashes))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.n = keys[order], np.concatenate((self.at, at))[order], np.concatenate((self.n, n))[order]
        self.raw_at, self.raw_n = np.concatenate((self.raw_at, raw_at))[order], np.concatenate((self.raw_n, raw_n))[order]

    def same(self, place: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
        """Whether the known pieces have the very bytes of data's, which lie one behind the other."""
        if not len(starts):
            return True
        if (self.raw_n[place] != ends - starts).any():
            return False
        raw, at = np.frombuffer(self.raw, np.uint8), np.arange(starts[0], len(data))
        equal = bool((raw[np.repeat(self.raw_at[place] - starts, ends - starts) + at] == data[starts[0] :]).all())
        del raw  # else the pool couldn't grow
        return equal

    def encode(self, column: pa.Array, end: int) -> list[np.ndarray]:
        """Every text's ids and then `end`, as arrays of uint32."""
        data, offsets = buffers(column)
        starts = self.pieces(data, offsets)
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > MAX_PIECES:
            self.forget()
        place = np.searchsorted(self.keys, hashes)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == hashes[known]
        if len(new := np.flatnonzero(~known)):
            raw = data.tobytes()
            self.learn(hashes[new], [raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, hashes)
        if not self.same(place[which], data, starts, ends):  # two pieces share a hash: these texts are encoded whole
            whole = self.tokenizer.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)
            return [np.array([*e.ids, end], np.uint32) for e in whole]
        at, n = self.at[place][which], self.n[place][which]
        to = np.cumsum(n)
        flat = self.pool[np.repeat(at - (to - n), n) + np.arange(int(to[-1]) if len(to) else 0)]
        to = np.concatenate(([0], to))
        cuts = to[np.searchsorted(starts, offsets)]
        return [np.append(flat[a:b], np.uint32(end)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> PieceEncoder:
    """One for each Python worker: what it has learnt serves the worker's later tasks."""
    return PieceEncoder(path, added)


def tokenise(docs: DataFrame, tokenizer_path: str, end: int, doc_id: str, text: str, added: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), doc_tokens, and the document's place: part, before (tokens ahead of it in its part)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("part", T.LongType()), T.StructField("before", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, total = encoder(tokenizer_path, added), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = known.encode(batch.column("text"), end)
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(n), pa.array(np.full(len(n), part)), pa.array(total + np.cumsum(n) - n)], ["doc_id", "ids", "doc_tokens", "part", "before"])
                total += int(n.sum())

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end: int = 1, doc_id: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    text_batches(docs.sparkSession)
    parts = stage(tokenise(docs, tokenizer_path, end, doc_id, text, added), "tokens")
    totals = parts.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = stage(totals.select("part", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("base")), "bases")
    if base.count() <= MAX_BROADCAST_PARTITIONS:
        base = F.broadcast(base)
    at = F.col("base") + F.col("before")
    placed = parts.join(base, "part").withColumn("at", at).withColumn("to", F.col("at") + F.col("doc_tokens"))
    window = F.explode(F.sequence(F.expr(f"at div {length}"), F.expr(f"(to - 1) div {length}")))
    cut = placed.withColumn("sequence_id", window).withColumn("from", F.greatest("at", F.col("sequence_id") * length)).withColumn("length", F.least("to", (F.col("sequence_id") + 1) * length) - F.col("from")).withColumn("start", F.col("from") - F.col("at"))
    return cut.select("doc_id", "start", "length", F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"), "doc_tokens", "sequence_id", (F.col("from") - F.col("sequence_id") * length).alias("offset"))
