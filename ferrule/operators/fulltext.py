"""A stored, stemmed, positional index of texts, and the searches that read it.

`write_index` reads the texts once. A row of the index is a block: of one term, documents of one window of ids, in order, with their numbers of places, all these
places, and the greatest number. Blocks are made where the texts are read, some megabytes of text at a time, so a window may have several blocks of a term (one, where texts come in order
of their ids), and only whole blocks are shuffled, once. A term that every document holds is spread over as many rows as there are windows; rows are partitioned by a
hash of the term and sorted by it in their files, so a search reads the buckets and row groups of its terms alone.

Searches take many queries at once. A query's terms must all be in a document. The queries' blocks meet by window, each once for up to QUERIES queries; `top` first bounds each window's
scores by its blocks' greatest numbers of places, scores the most promising windows, and then the others whose bound reaches the k-th score found, so the result is that of a full scan.

Cases: a null text has no terms; a query of stop words alone finds nothing; rows with one key are one document only if the caller's keys are unique, which is expected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.stems import STOP_WORDS, stem
from ferrule.functions.text import terms as words_of

#: Ids in a window, buckets of terms, and windows of a bucket that one task writes.
WINDOW, BUCKETS, PART = 4096, 64, 32
#: Distinct terms of all queries that are pushed down into the scan; more are joined alone.
PUSHED = 1000
#: Queries that a window's blocks are sent to at once.
QUERIES = 1000
FIRST = 16
REACH = 100
#: Texts in an Arrow batch, bytes of text made into blocks at once, and places scored at once.
SENT, BYTES, SCORED = 1000, 16 << 20, 1 << 20
#: The window of documents without an id.
NO_ID = -(1 << 52)
LISTS = ["docs", "counts", "places"]
INDEX = "bucket int, term string, window long, n long, most int, docs array<int>, counts array<int>, places array<int>"
BLOCK = "term string, window long, n long, most int, docs array<int>, counts array<int>, places array<int>"
KEPT = np.full(256, 32, np.uint8)
for _sign in b"abcdefghijklmnopqrstuvwxyz0123456789":
    KEPT[_sign] = _sign


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every run of a-z and 0-9 of lower-cased texts, in order, and its row."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = KEPT[np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    split = pc.split_pattern(pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data)), " ")
    words, row = split.flatten(), np.repeat(np.arange(len(text)), pc.list_value_length(split).to_numpy())
    some = pc.not_equal(words, "")
    return words.filter(some), row[some.to_numpy(zero_copy_only=False)]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _blocks(doc: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """The blocks of some texts; stop words have a place but no block."""
    known = doc.is_valid().to_numpy(zero_copy_only=False)
    doc = pc.fill_null(doc, 0).to_numpy()
    window = np.where(known, doc // WINDOW, NO_ID)
    slot = np.where(known, doc % WINDOW, 0)
    order = np.lexsort((slot, window))
    words, row = _words(text.take(pa.array(order)))
    place = np.arange(1, len(row) + 1) - np.searchsorted(row, row)
    found = words.dictionary_encode()
    stems = [None if w in STOP_WORDS else stem(w) for w in found.dictionary.to_pylist()]
    number = {s: i for i, s in enumerate(dict.fromkeys(s for s in stems if s is not None))}
    code = np.array([number.get(s, -1) for s in stems], np.int64)[found.indices.to_numpy()]
    kept = np.flatnonzero(code >= 0)
    kept = kept[np.argsort(code[kept], kind="stable")]
    code, place, window, slot = code[kept], place[kept], window[order][row[kept]], slot[order][row[kept]]
    first = _starts(code, window, slot)
    counts = np.diff(np.append(first, len(code)))
    own = _starts(code[first], window[first])
    ends = np.append(own, len(first))
    lists = [(ends, slot[first]), (ends, counts), (np.append(first, len(code))[ends], place)]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(number), pa.string()).take(pa.array(code[first[own]])), pa.array(window[first[own]]), pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(counts, own).astype(np.int32) if len(own) else np.zeros(0, np.int32))]
        + [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for at, x in lists],
        ["term", "window", "n", "most", *LISTS],
    )


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of all texts, about BYTES of text (or one longer text) at a time."""
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy())
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + BYTES - size, "right")))
            held.append(b.slice(at, to - at))
            size += int(ends[to - 1] - base)
            at = to
            if at < b.num_rows or size >= BYTES:
                yield _of(held)
                held, size = [], 0
    if held:
        yield _of(held)


def _of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(held).combine_chunks()
    return _blocks(*(pa.concat_arrays(whole.column(c).chunks) for c in ("doc", "text")))


def write_index(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Writes the index of docs at path, and returns it. The session's Arrow batches are lowered to SENT rows."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= SENT:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SENT))
    blocks = docs.select(F.col(key).cast("long").alias("doc"), F.lower(text).alias("text")).mapInArrow(_indexed, BLOCK)
    placed = blocks.withColumn("bucket", bucket(F.col("term"))).withColumn("_part", F.floor(F.col("window") / PART))
    placed.repartition("bucket", "_part").sortWithinPartitions("bucket", "term", "window").drop("_part").write.partitionBy("bucket").parquet(path)
    return read_index(docs.sparkSession, path)


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """q, term and number (of the query's distinct stems) for every stem of every query that isn't a stop word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(q, s, i) for q, words in zip(b.column("q").to_pylist(), b.column("words").to_pylist(), strict=True) for i, s in enumerate(dict.fromkeys(stem(w) for w in words or [] if w not in STOP_WORDS))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], ["q", "term", "number"])

    named = queries.select(F.col(key).cast("long").alias("q"), words_of(F.col(text)).alias("words")).mapInArrow(run, "q long, term string, number int")
    return named.join(named.groupBy("q").agg(F.count(F.lit(1)).alias("terms")), "q")


def blocks_of(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The index's blocks of the queries' terms, each once for up to QUERIES queries, with these (asks). asked: q, term, number, terms, in a table that is cheap to read again."""
    wanted = [r[0] for r in asked.select("term").distinct().limit(PUSHED + 1).collect()]
    dealt = -(-asked.select("q").distinct().count() // QUERIES) or 1
    asks = asked.groupBy("term", F.pmod(F.xxhash64("q"), F.lit(dealt)).alias("part")).agg(F.collect_list(F.struct("q", "number", "terms")).alias("asks"))
    if len(wanted) <= PUSHED:
        numbers = [r[0] for r in asked.select(bucket(F.col("term"))).distinct().collect()]
        index = index.where(F.col("bucket").isin(numbers) & F.col("term").isin(wanted))
        asks = F.broadcast(asks) if asked.count() <= 100 * PUSHED else asks
    return index.join(asks, "term")


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    """A list of every row of a column."""
    if not table.num_rows:
        return []
    column = pa.concat_arrays(table.column(name).chunks)
    return np.split(column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())[:-1])


def _found(table: pa.Table, docs: list[np.ndarray], chosen: set[int] | None) -> Iterator[tuple[int, int, dict[int, list[int]], np.ndarray]]:
    """Of one window's blocks: each query (of the chosen ones) whose terms are all there, their number, the blocks of each, and which slots hold all of them."""
    asks: dict[int, tuple[int, dict[int, list[int]]]] = {}
    for i, of in enumerate(table.column("asks").to_pylist()):
        for a in of:
            if chosen is None or a["q"] in chosen:
                asks.setdefault(a["q"], (a["terms"], {}))[1].setdefault(a["number"], []).append(i)
    for q, (terms, own) in asks.items():
        if len(own) == terms:
            held = np.ones(WINDOW, bool)
            for rows in own.values():
                has = np.zeros(WINDOW, bool)
                for i in rows:
                    has[docs[i]] = True
                held &= has
            if held.any():
                yield q, terms, own, held


def _ids(window: int, slot: np.ndarray) -> pa.Array:
    return pa.nulls(len(slot), pa.int64()) if window == NO_ID else pa.array(window * WINDOW + slot.astype(np.int64))


def matches(blocks: DataFrame) -> DataFrame:
    """q, doc of every document that holds all of the query's terms."""

    def run(table: pa.Table) -> pa.Table:
        found = [(q, np.flatnonzero(held)) for q, _, _, held in _found(table, _lists(table, "docs"), None)]
        slot = np.concatenate([np.zeros(0, np.int64), *(s for _, s in found)])
        return pa.table({"q": pa.array(np.repeat(np.array([q for q, _ in found], np.int64), [len(s) for _, s in found])), "doc": _ids(table.column("window")[0].as_py(), slot)})

    return blocks.select("window", "part", "docs", "asks").groupBy("window", "part").applyInArrow(run, "q long, doc long")


def _pair(distance: np.ndarray, weight: float) -> np.ndarray:
    return weight * np.sqrt(1 / (1.005 + 0.05 * np.exp(distance / 1.5 - 2)))


def _near(first: np.ndarray, of: np.ndarray, number: np.ndarray, p: np.ndarray, terms: np.ndarray, weight: float) -> np.ndarray:
    """`rank` of each document: its places begin at first, `of` numbers each place's document."""
    at = np.arange(len(p))
    own = np.add.reduceat(weight / (at - first[of] + 1.0) ** 2, first) / 1.64493406685
    logs = np.log(1 - _pair(np.arange(REACH + 1.0), weight))
    logs[0] = 0
    log = np.zeros(len(p))
    at, back = at[terms[of] > 1], 0
    while len(at):
        back += 1
        at = at[at - first[of[at]] >= back]
        apart = p[at] - p[at - back]
        at, apart = at[apart <= REACH], apart[apart <= REACH]
        other = number[at] != number[at - back]
        log[at[other]] += logs[apart[other]]
    return np.where(terms == 1, own, 1 - np.exp(np.add.reduceat(log, first)))


def _covered(first: np.ndarray, of: np.ndarray, number: np.ndarray, p: np.ndarray, terms: np.ndarray, weight: float) -> np.ndarray:
    """`density` of each document: for each place the stretch ending there begins at the least of the terms' last places; it is shortest where that beginning moves on."""
    at = np.arange(len(p))
    begun = at
    for t in range(int(terms.max(initial=0))):
        begun = np.where(t < terms[of], np.minimum(begun, np.maximum.accumulate(np.where(number == t, at, -1))), begun)
    shortest = begun >= first[of]
    shortest[1:] &= (begun[1:] > begun[:-1]) | (of[1:] != of[:-1])
    end = at[shortest]
    b = begun[end]
    return np.bincount(of[end], weight / (1 + (p[end] - p[b]) - (end - b)), len(first))


SCORES = {"rank": _near, "density": _covered}


def _scored(table: pa.Table, how: str, weight: float, k: int | None, chosen: set[int] | None) -> Iterator[pa.Table]:
    """q, doc, score and score to twelve digits of a window's documents, or of each query's k best of them. Some queries' places, about SCORED, are scored at once."""
    docs, counts, places = (_lists(table, name) for name in LISTS)
    spread = [np.repeat(d, n) for d, n in zip(docs, counts, strict=True)]

    def done(held: list[tuple[int, int, np.ndarray, int, np.ndarray]]) -> pa.Table:
        size = [len(h[4]) for h in held]
        nth, terms, number = (np.repeat(x, size) for x in (np.cumsum([0] + [a[0] != b[0] for a, b in zip(held[1:], held, strict=False)]), [h[1] for h in held], [h[3] for h in held]))
        slot, p = np.concatenate([h[2] for h in held]), np.concatenate([h[4] for h in held]).astype(np.int64)
        order = np.lexsort((p, slot, nth))
        nth, terms, number, slot, p = nth[order], terms[order], number[order], slot[order], p[order]
        first = _starts(nth, slot)
        score = SCORES[how](first, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p)))), number, p, terms[first], weight)
        nth, slot, rounded = nth[first], slot[first], np.round(score, 12)
        if k is not None:
            best = np.lexsort((slot, -rounded, nth))
            best = best[np.arange(len(best)) - np.searchsorted(nth, nth[best]) < k]
            nth, slot, score, rounded = nth[best], slot[best], score[best], rounded[best]
        names = np.array(list(dict.fromkeys(h[0] for h in held)), np.int64)
        return pa.table({"q": names[nth], "doc": _ids(table.column("window")[0].as_py(), slot), "score": score, "rounded": rounded})

    held, size = [], 0
    for q, terms, own, hit in _found(table, docs, chosen):
        for number, i in ((number, i) for number, rows in own.items() for i in rows):
            kept = hit[spread[i]]
            held.append((q, terms, spread[i][kept], number, places[i][kept]))
            size += len(held[-1][4])
        if size >= SCORED:
            yield done(held)
            held, size = [], 0
    if held:
        yield done(held)


def _score(blocks: DataFrame, how: str, weight: float, k: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """q, doc, score and rounded of all windows, or of the pairs of query (q, part) and window."""
    schema, names = "q long, doc long, score double, rounded double", ["q", "doc", "score", "rounded"]
    nothing = pa.table({c: pa.array([], pa.int64() if c in ("q", "doc") else pa.float64()) for c in names})
    needed = blocks.select("window", "part", "asks", *LISTS).groupBy("window", "part")
    if pairs is None:
        return needed.applyInArrow(lambda t: pa.concat_tables([nothing, *_scored(t, how, weight, k, None)]), schema)
    run: Callable[[pa.Table, pa.Table], pa.Table] = lambda t, c: pa.concat_tables([nothing, *(_scored(t, how, weight, k, set(c.column("q").to_pylist())) if t.num_rows and c.num_rows else [])])
    return needed.cogroup(pairs.select(F.col("window").alias("at"), F.col("part").alias("of"), F.col("q").alias("q")).groupBy("at", "of")).applyInArrow(run, schema)


def rank(blocks: DataFrame, weight: float = 0.1) -> DataFrame:
    """q, doc, score: of a query of one term the sum of weight / j^2 over its j-th places, over pi^2 / 6; of several the chance that one at least of
    the pairs of different terms' places, REACH words apart at most, counts, each the more the nearer."""
    return _score(blocks, "rank", weight).drop("rounded")


def density(blocks: DataFrame, weight: float = 0.1) -> DataFrame:
    """q, doc, score by cover density: `weight` for each shortest stretch that has all terms, over one more than its other words."""
    return _score(blocks, "density", weight).drop("rounded")


def bounds(blocks: DataFrame, how: str, weight: float = 0.1) -> DataFrame:
    """q, part, window and bound: no document of the window scores above it."""
    each = blocks.select("window", "part", "most", F.explode("asks").alias("a")).select("a.q", "part", "window", "a.number", "a.terms", "most")
    own = each.groupBy("q", "part", "window", "number").agg(F.first("terms").alias("terms"), F.max("most").alias("most"))
    all_of = own.groupBy("q", "part", "window").agg(F.first("terms").alias("terms"), F.count(F.lit(1)).alias("c"), F.sum("most").alias("total"), F.sum(F.col("most").cast("double") * F.col("most")).alias("squares"), F.max("most").alias("most")).where("c = terms")
    if how == "density":
        return all_of.select("q", "part", "window", (weight * F.col("total")).alias("bound"))
    pairs = (F.col("total").cast("double") * F.col("total") - F.col("squares")) / 2
    closest = weight * math.sqrt(1 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2)))
    one = weight * F.least(1 + F.log(F.col("most").cast("double")), F.lit(math.pi**2 / 6)) / 1.64493406685  # sums of 1 / j^2 stay below 1 + ln n
    return all_of.select("q", "part", "window", F.when(F.col("terms") == 1, one).otherwise(1 - F.pow(F.lit(1 - closest), pairs)).alias("bound"))


def top(index: DataFrame, asked: DataFrame, k: int, how: str = "rank", weight: float = 0.1) -> DataFrame:
    """q, doc, score: each query's k best documents, equal scores by doc. Bounds and the first windows' best are cached, since they are read twice."""
    blocks = blocks_of(index, asked)
    best = Window.partitionBy("q").orderBy(F.desc("bound"), "window")
    order = Window.partitionBy("q").orderBy(F.desc("rounded"), "doc")
    nth = bounds(blocks, how, weight).withColumn("nth", F.row_number().over(best)).cache()
    some = _score(blocks, how, weight, k, nth.where(F.col("nth") <= FIRST)).cache()
    reached = some.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("q", F.col("score").alias("reached"))
    open_ = nth.where(F.col("nth") > FIRST).join(reached, "q", "left").where("reached is null or bound >= reached * (1 - 1e-9)")
    scored = some.unionByName(_score(blocks, how, weight, k, open_))
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "doc", "score")
