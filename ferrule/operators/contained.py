"""Which texts contain which strings: an equi-join on seeds, verified.

Of the Q-grams in each window of `least` characters the one with the least hash is the window's seed. A text sends all its seeds, with their places; a string sends the seed of
its first window alone. Where the string stands in a text, the text has that seed at the same distance, so an equi-join on the seeds' hashes finds every place, and the place is checked
against the text. Equal strings are sought once, and a text is sent to its checks once, with all its candidate strings.

Where the strings have SENT seeds at most these go to the tasks, and texts send no others; else a filter of BITS bits does, which lets few others through.

Strings shorter than `least` are sought with windows of the least of their lengths below the same power of two, longer ones with windows of WIDER times `least`, whose seeds are rarer.

Where the strings are lines of the texts themselves, `lines_within` compares distinct lines: a line that stands as a whole one is found by its digest, and of the others only seeds, places and digests are shuffled,
and the lines that may hold another.

Cases: null and empty strings and null texts match nothing; a text that holds a string several times gives its first place; rows with one id are rows of their own only if the
caller's ids are unique, which is expected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.sources.store import shared_path

LEAST = 16
#: Seeds of strings that are sent to every task, so that texts give only rows that have one of them.
SENT = 100_000
#: Bits of the filter of more seeds, and times `least` of the windows of longer strings.
BITS, WIDER = 1 << 27, (4, 2)
#: Characters of a line that are looked at together at most; places among twice as many have 24 bits.
PIECE = 1 << 22


def _seeds(text: str, least: int, q: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a text's seeds; of its first window alone if asked."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if first:
        codes = codes[:least]
    if len(codes) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, n = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while n < q:  # hashes of n characters make those of twice as many, overlapping for the last
        step = min(n, q - n)
        h, n = (h[:-step] ^ h[:-step] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + (h[step:] ^ h[step:] >> np.uint64(31)), n + step
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    windows = np.lib.stride_tricks.sliding_window_view(h, least - q + 1)
    at = np.unique(np.argmin(windows, axis=1) + np.arange(len(windows)))
    return h[at].view(np.int64), at


def _few(seeded: DataFrame) -> np.ndarray:
    """The distinct seeds, sorted, if they are few enough to go to every task; else a filter, bit by bit, whose size doesn't depend on their number."""
    found = [r[0] for r in seeded.select("seed").distinct().limit(SENT + 1).collect()]
    if len(found) <= SENT:
        return np.array(sorted(found), np.int64)
    bit = F.pmod("seed", F.lit(BITS))
    rows = seeded.groupBy(F.floor(bit / 32768).alias("at")).agg(F.bitmap_construct_agg(bit % 32768)).collect()
    bits = np.zeros((BITS // 32768, 4096), np.uint8)
    for at, some in rows:
        bits[at] = np.frombuffer(some, np.uint8)
    return bits.reshape(-1)


def _held(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the seeds are among the wanted ones, or seem to be by their filter."""
    if not len(wanted):
        return np.zeros(len(h), bool)
    if wanted.dtype == np.uint8:
        bit = h & np.int64(BITS - 1)
        return wanted[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
    return wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h


def _seeded(df: DataFrame, key: str, least: int, first: bool, wanted: np.ndarray | None = None) -> DataFrame:
    """seed, key and at, the seed's place, of df's rows (key, text); of the `wanted` seeds alone, if they are given."""
    q = least // 2 + 1 if least > 3 else least

    sent = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)

    def kept(found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if sent is None:
            return found
        h, at = found
        have = _held(h, sent.value)
        return h[have], at[have]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = [kept(_seeds(t or "", least, q, first)) for t in part.column("text").to_pylist()]
                n = [len(h) for h, _ in found]
                ids = part.column(key).take(pa.array(np.repeat(np.arange(part.num_rows), n)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for h, _ in found])), ids, pa.array(np.concatenate([a for _, a in found]))], ["seed", key, "at"])

    return df.select(key, "text").mapInArrow(run, f"seed long, {key} {df.schema[key].dataType.simpleString()}, at long")


def contained(strings: DataFrame, texts: DataFrame, string: str, text_id: str, text: str, least: int = LEAST) -> DataFrame:
    """string, text_id and place (from 1) of every text that contains a string. strings: the column `string`; it need not be distinct."""
    sought = strings.select(F.col(string).alias("text")).where("text <> ''").distinct().select(F.xxhash64("text", F.length("text")).alias("sid"), "text")
    sought = sought.groupBy("sid").agg(F.collect_set("text").alias("texts"))  # strings of one hash stay apart in the check
    sought.write.parquet(path := shared_path(texts.sparkSession, "sought"))
    sought = texts.sparkSession.read.schema(sought.schema).parquet(path)
    each = sought.select("sid", F.explode("texts").alias("text"))
    whole = texts.select(F.col(text_id).alias("tid"), F.col(text).alias("text"))
    short = [r[0] for r in each.where(F.length("text") < least).select(F.length("text")).distinct().collect()]
    places = []
    brackets: dict[int, int] = {}  # of the short lengths below the same power of two the least, whose windows serve them all
    for n in short:
        b = n if n < 4 else n.bit_length() + 4
        brackets[b] = min(n, brackets.get(b, n))
    longest = each.agg(F.max(F.length("text"))).first()[0] or 0
    wide = [least * k for k in WIDER if least * k <= longest]
    bounds = [*wide, least, *sorted(brackets.values(), reverse=True)]
    for size, above in zip(bounds, [None, *bounds], strict=False):
        some = each.where((F.length("text") >= size) & (F.length("text") < above if above else F.lit(True)))
        a = _seeded(some, "sid", size, True).withColumnRenamed("at", "off").distinct()
        b = _seeded(whole, "tid", size, False, _few(a))
        places.append(b.join(a, "seed").where("at >= off").select("tid", "sid", (F.col("at") - F.col("off") + 1).alias("place")))
    found = reduce(DataFrame.unionByName, places).groupBy("tid", "sid").agg(F.array_sort(F.collect_set("place")).alias("places"))
    by_text = found.join(sought, "sid").select("tid", F.explode("texts").alias("string"), "places").groupBy("tid").agg(F.collect_list(F.struct("string", "places")).alias("sought"))
    checked = whole.join(by_text, "tid").select("tid", F.explode(F.transform("sought", lambda x: F.struct(x["string"].alias("string"), F.filter(x["places"], lambda p: F.substring(F.col("text"), p, F.length(x["string"])) == x["string"]).alias("places")))).alias("x"), )
    return checked.select(F.col("x.string").alias(string), F.col("tid").alias(text_id), F.get("x.places", F.lit(0)).alias("place")).where("place is not null")


def digest(text: Column) -> Column:
    """What names a line: 16 bytes of its SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _least(texts: list[str], size: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of `size` characters of the texts put together the least hash of its grams of q characters, less its last 24 bits, and the gram's place; of equal ones the first. PIECE characters a text and 64 texts at most."""
    h, n = (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    if len(h) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    while n < q:
        step = min(n, q - n)
        h, n = (h[:-step] ^ h[:-step] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + (h[step:] ^ h[step:] >> np.uint64(31)), n + step
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h = h & ~np.uint64((1 << 24) - 1) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while n < size - q + 1:  # least of n places, then of twice as many
        step = min(n, size - q + 1 - n)
        h, n = np.minimum(h[:-step], h[step:]), n + step
    return h >> np.uint64(24), (h & np.uint64((1 << 24) - 1)).astype(np.int64)


def _line_seeds(lines: DataFrame, least: int, first: bool, wanted: np.ndarray | None = None) -> DataFrame:
    """seed, id, at and n, its line's length, of lines (id, text, n): of the first window of the longest size that a line has, or of all windows of all sizes, the `wanted` alone. Seeds of one size are unlike those of others."""
    sizes = [*[least * k for k in WIDER], least]
    sent = None if wanted is None else lines.sparkSession.sparkContext.broadcast(wanted)

    def of_part(rows: list[int], bases: list[int], texts: list[str], lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Seeds, rows and places of some lines, or pieces of lines that start at `bases`."""
        has = np.array([len(t) for t in texts])
        starts, rows, bases = np.cumsum(has) - has, np.array(rows), np.array(bases)
        for k, size in enumerate(sizes):
            h, at = _least(texts, size, size // 2 + 1)
            if first:
                own = np.flatnonzero((lengths[rows] >= size) & ((lengths[rows] < sizes[k - 1]) if k else True))
                h, at = h[starts[own]], at[starts[own]]
            else:
                own = np.repeat(np.arange(len(texts)), has)[: len(h)]
                fits = np.flatnonzero(np.arange(len(h)) + size <= (starts + has)[own])
                fits = fits[np.diff(at[fits], prepend=-1) != 0]
                h, at, own = h[fits], at[fits], own[fits]
            h = h.astype(np.int64) ^ np.int64(size << 44)
            if sent is not None:
                have = np.flatnonzero(_held(h, sent.value))
                h, at, own = h[have], at[have], own[have]
            yield h, rows[own], at - starts[own] + bases[own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done: set[bytes] = set()
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                pieces = []
                for row, name in enumerate(part.column("id").to_pylist()):
                    if name not in done:
                        done.add(name)
                        text = part.column("text")[row].as_py()
                        pieces += [(row, c, text[c : c + PIECE + sizes[0]]) for c in range(0, max(1, len(text) - sizes[0]), PIECE)]
                lengths, held = part.column("n").to_numpy(), []
                for row, base, text in [*pieces, (None, 0, "")]:
                    if held and (row is None or sum(len(t) for *_, t in held) + len(text) > 2 * PIECE):
                        for h, rows, at in of_part(*map(list, zip(*held, strict=True)), lengths):
                            own = pa.array(rows)
                            yield pa.RecordBatch.from_arrays([pa.array(h), part.column("id").take(own), pa.array(at.astype(np.int32)), part.column("n").take(own)], ["seed", "id", "at", "n"])
                        held = []
                    held.append((row, base, text))

    return lines.mapInArrow(run, "seed long, id binary, at int, n int")


def lines_within(lines: DataFrame, least: int) -> DataFrame:
    """id and within: the digests of every two different lines of which the second contains the first. lines: the column `line`, of `least` characters or more; it need not be distinct."""
    each = lines.select(digest(F.col("line")).alias("id"), F.col("line").alias("text"), F.length("line").alias("n"))
    begun = _line_seeds(each.withColumn("text", F.left("text", F.lit(least * max(WIDER)))), least, True)
    begun.write.parquet(path := shared_path(lines.sparkSession, "begun"))
    begun = lines.sparkSession.read.schema(begun.schema).parquet(path)
    a = begun.select("seed", F.col("id").alias("sid"), F.col("at").alias("off"), F.col("n").alias("size")).repartition("seed").dropDuplicates()
    b = _line_seeds(each, least, False, _few(begun))
    may = (F.col("n") > F.col("size")) & (F.col("at") >= F.col("off")) & (F.col("at") - F.col("off") + F.col("size") <= F.col("n"))
    pairs = b.join(a, "seed").where(may).select("id", "sid", (F.col("at") - F.col("off") + 1).alias("place"), "size").distinct()
    pairs.write.parquet(path := shared_path(lines.sparkSession, "places"))
    pairs = lines.sparkSession.read.schema(pairs.schema).parquet(path)
    holders = pairs.groupBy("id").agg(F.collect_list(F.struct("sid", "place", "size")).alias("sought"))
    some = _asked(each.withColumn("seed", F.xxhash64("id")), _few(pairs.select(F.xxhash64("id").alias("seed"))))
    checked = some.dropDuplicates(["id"]).join(holders, "id")
    found = checked.select(F.col("id").alias("within"), F.explode(F.filter("sought", lambda x: digest(F.substring(F.col("text"), x["place"], x["size"])) == x["sid"])["sid"]).alias("id"))
    return found.select("id", "within").distinct()


def _asked(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Rows whose seed is among the wanted ones, or seems to be."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_held(b.column("seed").to_numpy(), sent.value)))

    return rows.mapInArrow(run, rows.schema)
