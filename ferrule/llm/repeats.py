"""Long repeats across documents, by run-length indexes of the places that can repeat.

A byte is removed if a string of `length` bytes covers it that also starts in a document with a smaller doc_id.

Where strings can repeat: of the K-byte strings in each window of `length` bytes the one with the least hash is the window's anchor, so equal windows have equal anchors, and
windows in a row that share one make a segment. Texts are staged in chunks. A chunk sends its anchors' hashes with their counts, in arrays by hash
bucket; a bucket answers each chunk which of them occur again in the corpus, and which do so over HOT times. Segments of repeated anchors are
then dealt out by their anchor, each chunk's distinct ones with the range of doc_ids that have them. Windows of a hot anchor are dealt out one by one, by their own
bytes, so no anchor brings more than HOT segments together, and a passage that many documents share has one row for each chunk.

The index: a bucket's distinct segments, INDEX_BYTES at a time and never cutting an anchor's, are suffix-sorted, and their Burrows-Wheeler transform is kept as runs, cut where
neighbouring suffixes share less than `length` bytes. Each run's end is sampled: the least doc_id of its `length`-byte context. The segments are then streamed through the index from
their ends, all in step; the matching statistic grows by a byte with each step of the LF mapping, and wherever it has reached `length` the run's sample tells
the least document with these bytes. It goes back to the chunks that hold the segment in a larger doc_id, where spans are joined and cut from the texts.

The passes over texts read the staged chunks, so they see the same rows. A chunk meets its answers by a shuffle of the compressed chunks, at any size.

Cases: a null text is empty; a text shorter than `length` bytes stays; a row with a null doc_id neither removes nor loses anything; rows with one doc_id don't remove from each
other; bytes are those of UTF-8, so what is kept may start or end within a character; one text must fit into a task; an empty table gives no rows; other columns aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.kernels import buffers, mix, slices
from ferrule.llm.staging import stage, text_batches

K = 24
CHUNK_BYTES, SLICE = 1 << 22, 1 << 20
INDEX_BYTES = 1 << 17
#: Text whose anchors, and whose repeated segments, go to one task.
TASK_BYTES = 1 << 25
HOT = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SINGLE = np.uint16(1 << 15)
_NONE = np.iinfo(np.int64).max


def _pack(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays), "zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


# -- anchors and segments


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position; a collision costs a comparison, never a wrong result."""
    h, base, eight = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), int(_ODD), None
    for w in (1, 2, 4, 8):
        eight = h  # of 8 bytes, in the last round
        h = h[:-w] * np.uint64(base) + h[w:]
        h ^= h >> np.uint64(31)
        base = (base * int(_ODD) + 2) % 2**64
    return mix(h[: len(h) - 8] * np.uint64(base) + eight[16:])


def _alone(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows at ascending places, from those of their first, middle and last K bytes, a slice of the bytes at a time."""
    out = np.empty(len(at), np.uint64)
    for x in range(0, len(data), SLICE):
        a, b = np.searchsorted(at, (x, x + SLICE))
        if a < b:
            h = _rolling(data[x : x + SLICE + length])
            out[a:b] = mix(sum(mix(h[at[a:b] - x + d] + np.uint64(d)) for d in sorted({*range(0, length - K, K), length - K})))
    return out


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row."""
    s = 1
    while 2 * s <= w:
        x, s = np.minimum(x[:-s], x[s:]), 2 * s
    return np.minimum(x[: len(x) - (w - s)], x[w - s :]) if w > s else x


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of windows with one anchor: its first byte, the byte after its last window, its text's number and its anchor's hash."""
    found = []
    for row, (a, b) in _stretches(offsets, length):
        part, inner = data[a:b], np.clip(offsets[row[0] : row[1] + 1] - a, 0, b - a)
        h = _rolling(part)
        low = np.uint64(SLICE * 2 - 1)
        at = (_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - K + 1) & low).astype(np.int64)
        ok = np.zeros(len(part) + 1, np.int32)  # windows that lie in one text
        np.add.at(ok, inner[:-1], 1)
        np.add.at(ok, np.maximum(inner[1:] - length + 1, inner[:-1]), -1)
        inside = np.cumsum(ok[: len(at)]) > 0
        new = inside.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        last = inside.copy()
        last[:-1] &= new[1:] | ~inside[1:]
        s, e = np.flatnonzero(new), np.flatnonzero(last) + length
        found.append((s + a, e + a, row[0] + np.searchsorted(inner, s, "right") - 1, h[at[s]]))
    if not found:
        return (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _stretches(offsets: np.ndarray, length: int) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    """First and last text (after it) and first and last byte of parts of about SLICE bytes; a long text falls into parts whose windows follow on each other."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        a, b = int(offsets[at]), int(offsets[to])
        if to > at + 1 or b - a <= SLICE:
            if b - a >= length:
                yield (at, to), (a, b)
        else:
            for x in range(a, b - length + 1, SLICE - length):
                yield (at, to), (x, min(b, x + SLICE - 1))
        at = to


class _Chunk:
    """A chunk's texts and segments; `marks` tells of each bucket's anchors, in order, how often they occur: 1, 2 (again), 3 (hot)."""

    def __init__(self, ids: list, sizes: list[int], texts: bytes, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.data = np.frombuffer(_unpack(texts, sum(sizes)), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)))).astype(np.int64)
        self.known = np.array([i is not None for i in ids], bool)
        self.ids = np.array([i if i is not None else _NONE for i in ids], np.int64)
        start, end, row, anchor = segments(self.data, self.offsets, length)
        own = self.known[row]
        self.start, self.end, self.row = start[own], end[own], row[own]
        mixed = mix(anchor[own] + _ODD)  # anchors are the least of many hashes, so their own first bits are mostly 0
        self.bucket = ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        self.value = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def anchors(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each bucket its anchors' values, sorted, and their counts (65,535 at most)."""
        key, n = _distinct((self.bucket << 32) | self.value)
        edges = np.searchsorted(key, np.arange(self.buckets + 1) << 32)
        for k in np.flatnonzero(np.diff(edges)):
            part = slice(edges[k], edges[k + 1])
            yield int(k), (key[part] & 0xFFFFFFFF).astype(np.uint32), np.minimum(n[part], 65_535).astype(np.uint16)

    def repeated(self, marks: dict[int, bytes]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each bucket its distinct segments by bytes, and of all that occur: which one it is, its first byte, its text and whether it's a window of a hot anchor."""
        key = _distinct((self.bucket << 32) | self.value)[0]
        mark, edges = np.ones(len(key), np.uint8), np.searchsorted(key, np.arange(self.buckets + 1) << 32)
        for k, packed in marks.items():
            mark[edges[k] : edges[k + 1]] = np.frombuffer(_unpack(packed, int(edges[k + 1] - edges[k])), np.uint8)
        mark = mark[np.searchsorted(key, (self.bucket << 32) | self.value)]
        again, hot = np.flatnonzero(mark == 2), np.flatnonzero(mark == 3)
        windows = self.end[hot] - self.start[hot] - self.length + 1
        each = np.repeat(self.start[hot], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        each.sort()
        own = _alone(self.data, each, self.length)
        alone = ((own >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        start = np.concatenate((self.start[again], each))
        size = np.concatenate(((self.end - self.start)[again], np.full(len(each), self.length)))
        row = np.concatenate((self.row[again], np.searchsorted(self.offsets, each, "right") - 1))
        bucket, single = np.concatenate((self.bucket[again], alone)), np.arange(len(start)) >= len(again)
        order = np.argsort(bucket, kind="stable")
        start, size, row, bucket, single = start[order], size[order], row[order], bucket[order], single[order]
        edges = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            part = slice(edges[k], edges[k + 1])
            one = _binary(_gathered(self.data, start[part], size[part]), size[part]).dictionary_encode()
            yield int(k), one.dictionary, one.indices.to_numpy(), start[part], row[part], single[part]


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after the other."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """The same as an array of values."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(data)])


def _parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of a new array's values."""
    bounds = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[: bounds[-1]], np.diff(bounds)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and how often each occurs."""
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key)))


# -- the index


class RunIndex:
    """Run-compressed transform of distinct segments, with each run's end sampled.

    starts: first row of each run. to: where the LF mapping takes that row. sample: the least doc_id among segments that hold the `length` bytes after the
    run's rows (_NONE where fewer are left). heads and ranks: a bit for each row that starts a run, and the runs before each eighth row's byte.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, least: np.ndarray, length: int):
        size = np.diff(bounds)
        n, self.count = len(data) + len(size), len(size)
        letters = np.flatnonzero(np.bincount(data, minlength=256))
        code = np.zeros(256, np.int64)
        code[letters] = np.arange(1, len(letters) + 1)
        text = np.zeros(n, np.int64)  # 0 ends a segment
        text[np.arange(len(data)) + np.repeat(np.arange(self.count), size)] = code[data]
        end = bounds[1:] + np.arange(self.count)
        left = (np.repeat(end, size + 1) - np.arange(n)).astype(np.int32)  # bytes to the segment's end

        width = len(letters).bit_length()
        depth = max(1, min(length, (63 - n.bit_length()) // width))
        key = np.zeros(n, np.int64)
        for d in range(depth):
            key <<= width
            key[: n - d] |= np.where(left[: n - d] > d, text[d:], 0)
        order, rank = _sorted(key)
        at_depth = {depth: rank}
        while depth < int(size.max(initial=0)) + 1:
            wide = np.zeros(n, np.int64)
            if depth < n:
                wide[: n - depth] = np.where(left[: n - depth] >= depth, rank[depth:], 0)
            order, rank = _sorted(wide, rank)
            depth *= 2
            at_depth[depth] = rank
        # suffixes that are equal to their ends stand by their segment's number

        base = max(d for d in at_depth if d <= length)
        a, b = order[:-1], order[1:]
        whole = left[order] >= length
        same = whole[:-1] & whole[1:]
        for d in (*range(0, length - base, base), length - base):
            r = at_depth[base]
            same &= r[np.minimum(a + d, n - 1)] == r[np.minimum(b + d, n - 1)]
        same |= ~whole[:-1] & ~whole[1:]  # shorter ones have no context, and share the sample of none
        cut = np.concatenate(([True], ~same))
        doc = np.where(whole, np.repeat(least, size + 1)[order], _NONE)
        first = np.flatnonzero(cut)
        block = np.minimum.reduceat(doc, first) if n else doc

        text_before = np.append(0, text[:-1])
        text_before[bounds[:-1] + np.arange(self.count)] = 0
        before = text_before[order]
        head = cut | np.concatenate(([True], before[1:] != before[:-1]))
        self.starts = np.flatnonzero(head)
        self.sample = block[np.cumsum(cut)[self.starts] - 1]
        char, run = before[self.starts], np.diff(np.append(self.starts, n))
        by_char = np.argsort(char.astype(np.uint16), kind="stable")
        self.to = np.zeros(len(char), np.int64)
        total = np.bincount(text, minlength=len(letters) + 1)
        smaller = np.cumsum(total) - total
        done = np.cumsum(run[by_char]) - run[by_char]
        group = char[by_char]
        runs = np.bincount(char, minlength=len(total))
        self.to[by_char] = (smaller - done[np.minimum(np.cumsum(runs) - runs, len(done) - 1)])[group] + done
        self.bits = np.packbits(head)
        self.ranks = np.concatenate(([0], np.cumsum(np.unpackbits(self.bits).reshape(-1, 8).sum(1)))).astype(np.int32)

    def run(self, row: np.ndarray) -> np.ndarray:
        """The run that holds each row."""
        return self.ranks[row >> 3] + _ONES[self.bits[row >> 3] >> (7 - (row & 7))] - 1

    def stream(self, size: np.ndarray, length: int) -> np.ndarray:
        """Matching statistics of the indexed segments, from their ends on: the least doc_id for each window, segment by segment."""
        windows = np.maximum(size - length + 1, 0)
        out = np.full(int(windows.sum()), _NONE, np.int64)
        first = np.cumsum(windows) - windows
        who = np.argsort(-size, kind="stable")
        row = who.copy()  # the suffix that is a segment's end alone stands in the row of its number
        for matched in range(1, int(size.max(initial=0)) + 1):
            who = who[: np.searchsorted(-size[who], -matched, "right")]
            row = row[: len(who)]
            run = self.run(row)
            row = self.to[run] + row - self.starts[run]
            if matched >= length:
                out[first[who] + size[who] - matched] = self.sample[self.run(row)]
        return out


_ONES = np.array([bin(x).count("1") for x in range(256)], np.int64)


def _sorted(key: np.ndarray, above: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by `above`, key and position, and each one's rank among the distinct pairs of the first two. A key leaves room for a position in 63 bits."""
    n, bits = len(key), len(key).bit_length()
    if above is not None and 3 * bits > 63:
        order = np.lexsort((key, above))
        new = (above[order][1:] != above[order][:-1]) | (key[order][1:] != key[order][:-1])
    else:
        both = key if above is None else (above.astype(np.int64) << bits) | key
        both = np.sort((both << bits) | np.arange(n))
        order = both & ((1 << bits) - 1)
        both >>= bits
        new = both[1:] != both[:-1]
    rank = np.zeros(n, np.int32)
    rank[order[1:]] = np.cumsum(new, dtype=np.int32)
    return order, rank


def least_documents(data: np.ndarray, size: np.ndarray, least: np.ndarray, single: np.ndarray, length: int) -> np.ndarray:
    """For the windows of each segment, one after the other, the least doc_id that has them. Segments are distinct; single: windows dealt out by themselves."""
    starts, windows = np.cumsum(size) - size, size - length + 1
    first = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    for some in _by_anchor(data, size, single, length):
        own = size[some]
        index = RunIndex(_gathered(data, starts[some], own), np.concatenate(([0], np.cumsum(own))), least[some], length)
        many = windows[some]
        out[np.repeat(first[some] - (np.cumsum(many) - many), many) + np.arange(many.sum())] = index.stream(own, length)
    return out


# -- passes


def _chunks(docs: DataFrame) -> DataFrame:
    """chunk, ids, sizes and the compressed texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column("doc_id") for b in held])
            parts = [buffers(b.column("text")) for b in held]
            texts = pa.compress(b"".join(d.tobytes() for d, _ in parts), "zstd", asbytes=True)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, pa.array(np.concatenate([np.diff(o) for _, o in parts])))]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([texts], pa.binary())], ["chunk", "ids", "sizes", "texts"])

        for whole in batches:
            for b in slices(whole, "text"):
                held.append(b)
                size += b.column("text").nbytes
                if size >= CHUNK_BYTES:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    return docs.mapInArrow(rows, "chunk long, ids array<long>, sizes array<long>, texts binary")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _anchors(chunks: DataFrame, length: int, buckets: int) -> DataFrame:
    """bucket, chunk, n (anchors) and their packed values and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _each(batches):
            made = [(k, c["chunk"], len(v), _pack(v, n)) for k, v, n in _Chunk(c["ids"], c["sizes"], c["texts"], length, buckets).anchors()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)] if made else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())], ["bucket", "chunk", "n", "data"])

    return chunks.mapInArrow(run, "bucket long, chunk long, n long, data binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each bucket, from rows sorted by it."""
    held: list[dict] = []
    for r in _each(batches):
        if held and r["bucket"] != held[0]["bucket"]:
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def _answers(anchors: DataFrame, tasks: int, hot: int) -> DataFrame:
    """bucket, chunk and a packed mark for each of its anchors; none where no anchor occurs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            raw = [_unpack(r["data"], 6 * r["n"]) for r in rows]
            values = np.concatenate([np.frombuffer(x, np.uint32, r["n"]) for x, r in zip(raw, rows, strict=True)])
            n = np.concatenate([np.frombuffer(x, np.uint16, r["n"], 4 * r["n"]) for x, r in zip(raw, rows, strict=True)])
            distinct, at = np.unique(values, return_inverse=True)
            total = np.bincount(at, weights=n)
            mark = (1 + (total > 1) + (total > hot)).astype(np.uint8)[at]
            made, first = [], 0
            for r in rows:
                own = mark[first : first + r["n"]]
                first += r["n"]
                if (own > 1).any():
                    made.append((r["bucket"], r["chunk"], _pack(own)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["bucket", "chunk", "data"])

    return anchors.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, chunk long, data binary")


def _joined(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Chunks with what was answered to them; those without an answer too."""
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct(*[c for c in answers.columns if c != "chunk"])).alias(name))
    return chunks.join(by_chunk, "chunk", "left")


def _dealt(marked: DataFrame, length: int, buckets: int) -> DataFrame:
    """bucket, chunk, n, bytes and, packed, each distinct segment's size, its least and greatest doc_id and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _each(batches):
            if not c["marks"]:
                continue
            chunk = _Chunk(c["ids"], c["sizes"], c["texts"], length, buckets)
            made = []
            for k, found, at, _, row, single in chunk.repeated({m["bucket"]: m["data"] for m in c["marks"]}):
                low, high = np.full(len(found), _NONE, np.int64), np.full(len(found), -_NONE - 1, np.int64)
                np.minimum.at(low, at, chunk.ids[row])
                np.maximum.at(high, at, chunk.ids[row])
                data, size = _parts(found)
                size = size.astype(np.uint16)
                size[at[single]] |= _SINGLE
                made.append((k, c["chunk"], len(found), len(data), _pack(size, low, high, data)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["bucket", "chunk", "n", "bytes", "data"])

    return marked.mapInArrow(run, "bucket long, chunk long, n long, bytes long, data binary")


def _marked(dealt: DataFrame, length: int, tasks: int) -> DataFrame:
    """bucket, chunk, n and, packed, spans of windows with a smaller document: segment, first and last window and the least doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            sizes, lows, highs, parts = [], [], [], []
            for r in rows:
                raw = _unpack(r.pop("data"), 18 * r["n"] + r["bytes"])
                sizes.append(np.frombuffer(raw, np.uint16, r["n"]).astype(np.int64))
                lows.append(np.frombuffer(raw[2 * r["n"] : 10 * r["n"]], np.int64))
                highs.append(np.frombuffer(raw[10 * r["n"] : 18 * r["n"]], np.int64))
                parts.append(np.frombuffer(raw, np.uint8, r["bytes"], 18 * r["n"]))
            size, low, high, data = (np.concatenate(x) for x in (sizes, lows, highs, parts))
            single, size = size >= _SINGLE, size & ~np.int64(_SINGLE)
            del sizes, lows, highs, parts
            found = _binary(data, size).dictionary_encode()
            at = found.indices.to_numpy()
            least, alone = np.full(len(found.dictionary), _NONE, np.int64), np.zeros(len(found.dictionary), bool)
            np.minimum.at(least, at, low)
            alone[at[single]] = True
            data, own = _parts(found.dictionary)
            answer = least_documents(data, own, least, alone, length)
            windows = own - length + 1
            first, many = np.cumsum(windows) - windows, windows[at]
            starts = np.cumsum(many) - many
            answer = answer[np.repeat(first[at] - starts, many) + np.arange(many.sum())]
            of = np.repeat(np.arange(len(at)), many)
            late = answer < high[of]
            new = late.copy()
            new[1:] &= ~late[:-1] | (of[1:] != of[:-1]) | (answer[1:] != answer[:-1])
            last = late.copy()
            last[:-1] &= ~late[1:] | new[1:]
            s, e = np.flatnonzero(new), np.flatnonzero(last)
            seg, lo, hi, doc = of[s], s - starts[of[s]], e - starts[of[s]], answer[s]
            made, first = [], 0
            for r in rows:
                part = slice(np.searchsorted(seg, first), np.searchsorted(seg, first + r["n"]))
                if n := part.stop - part.start:
                    made.append((r["bucket"], r["chunk"], int(n), _pack((seg[part] - first).astype(np.uint32), lo[part].astype(np.uint16), hi[part].astype(np.uint16), doc[part].astype(np.int64))))
                first += r["n"]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["bucket", "chunk", "n", "data"])

    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, chunk long, n long, data binary")


def _by_anchor(data: np.ndarray, size: np.ndarray, single: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Numbers of segments, about INDEX_BYTES at a time; those with one anchor stay together, and single windows with their copies."""
    starts, low = np.cumsum(size) - size, np.uint64(2 * SLICE - 1)
    group, at = np.empty(len(size), np.uint64), 0
    while at < len(size):  # of about SLICE bytes at a time the least hash of each segment, as its windows have it
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE)))
        a, b = int(starts[at]), int(starts[to - 1] + size[to - 1])
        h = _rolling(data[a:b])
        end = np.repeat(starts[at:to] + size[at:to] - a, size[at:to])[: len(h)]
        inside = np.where(np.arange(len(h)) + K <= end, h & ~low, ~np.uint64(0))
        group[at:to] = np.minimum.reduceat(inside, starts[at:to] - a)
        at = to
    group[single] = _alone(data, starts[single], length) | np.uint64(1)  # an anchor's last bit is 0
    order = np.argsort(group, kind="stable")
    ends, group = np.cumsum(size[order]), group[order]
    at = 0
    while at < len(order):
        to = min(len(order), max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + INDEX_BYTES))))
        to = int(np.searchsorted(group, group[to - 1], "right"))
        yield order[at:to]
        at = to


def _cut(chunk: _Chunk, gone: np.ndarray) -> pa.RecordBatch:
    """Spans of what is gone, by text, and the bytes that are kept."""
    n = len(chunk.ids)
    opened = gone.copy()
    opened[1:] &= ~gone[:-1]
    inner = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
    opened[inner] = gone[inner]
    closed = gone.copy()
    closed[:-1] &= ~gone[1:]
    closed[inner[1:] - 1] = gone[inner[1:] - 1]
    s, e = np.flatnonzero(opened), np.flatnonzero(closed) + 1
    row = np.searchsorted(chunk.offsets, s, "right") - 1
    kept = np.concatenate(([0], np.cumsum(~gone)))[chunk.offsets]
    spans = pa.StructArray.from_arrays([pa.array(s - chunk.offsets[row]), pa.array(e - chunk.offsets[row])], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), spans)
    rest = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(chunk.data[~gone])])
    ids = pa.array(chunk.ids, mask=~chunk.known)
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(chunk.offsets)), lists, rest.cast(pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def repeats(docs: DataFrame, length: int = 50, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (first byte and the byte after the last) to be removed, and kept, the other bytes."""
    spark = docs.sparkSession
    text_batches(spark)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = stage(_chunks(named), "chunks")
    whole = chunks.agg(F.sum(F.expr("aggregate(sizes, 0L, (s, x) -> s + x)"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), whole // TASK_BYTES)
    buckets = 4 * tasks
    answers = stage(_answers(_anchors(chunks, length, buckets), tasks, hot), "answers")
    marked = _joined(chunks, answers, "marks")
    found = stage(_marked(_dealt(marked, length, buckets), length, tasks), "repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _each(batches):
            chunk = _Chunk(c["ids"], c["sizes"], c["texts"], length, buckets)
            gone = np.zeros(len(chunk.data) + 1, np.int32)
            answered = {m["bucket"]: m for m in c["found"] or []}
            for k, _, at, start, row, _ in chunk.repeated({m["bucket"]: m["data"] for m in c["marks"] or []}) if answered else ():
                if k not in answered:
                    continue
                m = answered[k]["n"]
                raw = _unpack(answered[k]["data"], 16 * m)
                seg, lo, hi, doc = np.frombuffer(raw, np.uint32, m), np.frombuffer(raw, np.uint16, m, 4 * m), np.frombuffer(raw, np.uint16, m, 6 * m), np.frombuffer(raw[8 * m :], np.int64)
                first, many = np.searchsorted(seg, at), np.searchsorted(seg, at, "right") - np.searchsorted(seg, at)
                of = np.repeat(np.arange(len(at)), many)
                span = np.repeat(first, many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                late = doc[span] < chunk.ids[row[of]]
                np.add.at(gone, start[of[late]] + lo[span[late]], 1)
                np.add.at(gone, start[of[late]] + hi[span[late]].astype(np.int64) + length, -1)
            gone = np.cumsum(gone[:-1]) > 0
            yield _cut(chunk, gone)

    both = _joined(marked, found, "found")
    return both.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
