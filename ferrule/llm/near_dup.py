"""Near-duplicate documents with HyperMinHash sketches.

A document's set is its distinct word shingles, as 64-bit hashes. Each hash falls into one of BANDS * ROWS registers; of the least
value in a register the sketch keeps the number of leading zeros and MANTISSA bits after them. A register into which none falls takes
the least of the set under a hash of its own, so small sets fill theirs too. Equal runs of ROWS registers (a band) make candidates;
register matches, corrected for chance collisions, estimate the Jaccard similarity, and pairs within 4.5 standard errors
of the threshold or above it are checked on the full sets, made anew from the texts.

Rows with equal sets are one class from the start, told by a 128-bit cryptographic digest of the whole sorted set; all else compares classes.
Two rounds find the links. In the first each class is compared with one member of each of its buckets, the one that shares buckets
with the most others, so a group of any size round one text is joined by a linear number of pairs. In the second, buckets that still hold several components
are compared in full but for pairs within a component: the largest component's members with all others, never with each other. Members go to
tasks in blocks of BLOCK rows or SHINGLES shingles, a pair is looked at in the first of its bands alone, and tasks return a spanning
forest of what the full sets link, never pairs. So no candidate is left out, and only members of large buckets that no link joins make work in the square of their number.

With 42 bands of 7 registers a pair at similarity 0.8 shares no band with probability 5e-5, one at 0.85 with 3e-7; the estimate drops a pair at 0.8 with probability 3e-6.

Cases: a null text or one without words has an empty set and links with nothing; a text with fewer words than a shingle
has the whole run as its one shingle; component_id is the least doc_id of a component, null ids left aside; rows
that repeat are equal sets; an empty table gives no rows; extra columns are kept by `keep_one` alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.graph import components, forest
from ferrule.llm.kernels import mix, shingles, slices, word_hashes
from ferrule.llm.staging import bounded, keep_rows, stage, text_batches, unstage

BANDS, ROWS, MANTISSA = 42, 7, 10
REGISTERS = BANDS * ROWS
BLOCK, SHINGLES = 1024, 1 << 19
_SEEDS = np.random.default_rng(7).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.random.default_rng(8).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def compress(values: np.ndarray) -> np.ndarray:
    """Leading zeros and the MANTISSA bits after the first one of 32-bit values, as 16 bits."""
    v = np.maximum(values.astype(np.uint64), np.uint64(1))
    bits = np.frexp(v.astype(np.float64))[1].astype(np.int64)  # the first one is bit number `bits`
    rest = (v << (64 - bits).astype(np.uint64) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (((32 - bits) << MANTISSA) | rest.astype(np.int64)).astype(np.uint16)


def sketches(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of REGISTERS compressed registers for every set of hashes h[bounds[i]:bounds[i+1]]; an empty set's are 0."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    cell = row.astype(np.uint64) * np.uint64(REGISTERS) + ((h >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32))
    both = np.sort((cell << np.uint64(32)) | (mix(h) & np.uint64(0xFFFFFFFF)))
    cells = (both >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(both), bool)
    first[1:] = cells[1:] != cells[:-1]
    least = np.full(n * REGISTERS, 2**32, np.uint64)
    least[cells[first]] = both[first] & np.uint64(0xFFFFFFFF)
    least = least.reshape(n, REGISTERS)
    missing = least == 2**32
    for i in np.flatnonzero(missing.any(1) & (np.diff(bounds) > 0)):
        own, gaps = h[bounds[i] : bounds[i + 1]], np.flatnonzero(missing[i])
        most = max(1, (1 << 18) // len(own))
        for k in range(0, len(gaps), most):
            part = gaps[k : k + most]
            least[i, part] = (mix(own[:, None] * _SEEDS[part]) >> np.uint64(32)).min(0)
    out = compress(np.minimum(least, np.uint64(2**32 - 1)).ravel()).reshape(n, REGISTERS)
    out[np.diff(bounds) == 0] = 0
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of every sketch; its last 6 bits are the band's number."""
    r = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    return (mix(mix((r + np.uint64(1)) * _ODD).sum(2, dtype=np.uint64)) & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less what chance gives unequal minima."""
    chance = 0.169919487159739 * 2.0 ** (1 - MANTISSA)
    return np.maximum((np.mean(a == b, axis=1) - chance) / (1 - chance), 0)


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def sketch_documents(docs: DataFrame, width: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, row_key, n_shingles, d1 and d2 (digest of the set; null if empty), registers (null where no other set can be similar enough)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *[T.StructField(c, T.LongType()) for c in ("row_key", "n_shingles", "d1", "d2")], T.StructField("registers", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text", rows=2048):
                hashes, row = word_hashes(b.column("_text"))
                h, bounds = shingles(hashes, row, b.num_rows, width)
                size, raw = np.diff(bounds), memoryview(h.view(np.uint8))
                digests = np.frombuffer(b"".join(blake2b(raw[8 * i : 8 * j], digest_size=16).digest() for i, j in zip(bounds[:-1], bounds[1:], strict=True)), np.int64).reshape(-1, 2)
                alone = size * (100 - percent) < percent  # a different set shares too little with one so small
                registers = pa.array([None if few else x.tobytes() for few, x in zip(alone, sketches(h, bounds), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(size.astype(np.int64)), *[pa.array(digests[:, k], mask=size == 0) for k in (0, 1)], registers], schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("_text")).mapInArrow(run, schema)


def _registers(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def bands_of(classes: DataFrame) -> DataFrame:
    """key and cls for every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                keys = band_keys(_registers(b.column("registers")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(b.column("cls").to_numpy(), BANDS))], ["key", "cls"])

    return classes.where("registers is not null").select("cls", "registers").mapInArrow(run, "key long, cls long")


def whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by group, cut where a group ends, with about `most` shingles (column n) unless one group has more."""
    held: list[pa.RecordBatch] = []
    weight, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        g, n = b.column("group").to_numpy(), np.cumsum(b.column("n").to_numpy())
        starts = np.flatnonzero(np.concatenate(([last is None or g[0] != last], g[1:] != g[:-1])))
        done = base = 0
        for s in starts:
            before = int(n[s - 1]) if s else 0
            if weight + before - base >= most:
                part = [*held, b.slice(done, s - done)]
                yield pa.Table.from_batches(part)
                held, weight, done, base = [], 0, s, before
        held.append(b.slice(done))
        weight, last = weight + int(n[-1]) - base, g[-1]
    if held:
        yield pa.Table.from_batches(held)


def compare(rows: DataFrame, members: DataFrame, width: int, percent: int, banded: bool) -> DataFrame:
    """Links between labels, as edges (a, b), that the full sets show within groups of rows (group, cls, label, low, own).

    Pairs of a group are compared if one is of its low block and one isn't, or if the group is its own block's; with `banded`, where `group_key` is
    the key of the first band that the two share. Each task's edges are a spanning forest of its links.
    """
    least = percent / 100 - 4.5 * float(np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS))
    full = rows.join(members.select("cls", "n", "registers", "text"), "cls").repartition("group").sortWithinPartitions("group", "cls")

    def likely(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Pairs to check."""
        g, label, n, own = (t[c].to_numpy() for c in ("group", "label", "n", "own"))
        low, key, registers = t["low"].to_numpy(), t["group_key"].to_numpy(), _registers(t["registers"])
        a, step, left, right = np.arange(len(g)), 0, [], []
        while len(a):
            step += 1
            a = a[a < len(g) - step]
            a = a[g[a] == g[a + step]]
            b = a + step
            use = (own[a] | (low[a] != low[b])) & (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            for k in range(0, int(use.sum()), 4096):
                p, q = a[use][k : k + 4096], b[use][k : k + 4096]
                same = registers[p] == registers[q]
                near = estimate(registers[p], registers[q]) >= least
                if banded:
                    near &= same.reshape(len(p), BANDS, ROWS).all(2).argmax(1) == (key[p] & 63)
                left.append(p[near])
                right.append(q[near])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2

    def linked(t: pa.Table, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which of the pairs (sorted by p) the full sets link."""
        used, at = np.unique(np.concatenate((p, q)), return_inverse=True)
        hashes, row = word_hashes(t["text"].combine_chunks().take(pa.array(used)))
        h, bounds = shingles(hashes, row, len(used), width)
        size, ids = np.diff(bounds), np.unique(h, return_inverse=True)[1]
        x, y = at[: len(p)], at[len(p) :]
        mark, out = np.zeros(len(ids) + 1, bool), np.zeros(len(p), bool)
        runs = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
        for s, e in zip(runs[:-1], runs[1:], strict=True):
            i, others = x[s], y[s:e]
            mine = ids[bounds[i] : bounds[i + 1]]
            mark[mine] = True
            cut = max(1, (1 << 20) // int(size[others].max()))
            for k in range(0, len(others), cut):
                some = others[k : k + cut]
                starts = np.concatenate(([0], np.cumsum(size[some])[:-1]))
                take = np.repeat(bounds[some] - starts, size[some]) + np.arange(int(size[some].sum()))
                shared = np.add.reduceat(mark[ids[take]].astype(np.int64), starts)
                out[s + k : s + k + len(some)] = 100 * shared >= percent * (size[i] + size[some] - shared)
            mark[mine] = False
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, SHINGLES):
            p, q = likely(t)
            if len(p):
                order = np.argsort(p, kind="stable")
                p, q = p[order], q[order]
                found = linked(t, p, q)
                label = t["label"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(label[p[found]], label[q[found]])], ["a", "b"])

    return full.mapInArrow(run, "a long, b long")


def blocks(rows: str, shingles: str) -> Column:
    """So many blocks that each has about BLOCK rows and SHINGLES shingles at most."""
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(shingles) / SHINGLES)).cast("int")


def find_roots(classes: DataFrame, texts: DataFrame, bands: DataFrame, width: int, percent: int) -> DataFrame | None:
    """node and root for every class that has a link; None if none has. classes: cls, n, doc_id, row_key, registers; texts: doc_id, row_key, text; bands: key, cls."""
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stage(bands.join(shared, "key"), "shared")
    degree = stage(shared.groupBy("cls").agg(F.sum("size").alias("degree")).join(classes.select("cls", "n", "doc_id", "row_key"), "cls"), "degree")
    wanted = degree.count()
    if not wanted:
        return None
    needed = bounded(degree.select("cls", F.col("doc_id").alias("_i"), F.col("row_key").alias("_k")), wanted)
    found = texts.join(needed, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("row_key") == F.col("_k"))).groupBy("cls").agg(F.first("text").alias("text"))
    members = stage(found.join(classes.select("cls", "n", "registers"), "cls"), "members")
    light = degree.select("cls", "n", "degree")
    at = stage(shared.join(bounded(light, wanted), "cls"), "at")
    unstage(shared)

    # first round: each class with the hub of each of its buckets
    hubs = at.groupBy("key").agg(F.max(F.struct("degree", F.col("cls").alias("hub"), F.col("n").alias("hub_n"))).alias("h")).select("key", "h.hub", "h.hub_n")
    alike = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    stars = stage(at.join(hubs, "key").where((F.col("cls") != F.col("hub")) & alike).select("hub", "cls", "n").distinct(), "stars")
    sizes = stars.groupBy("hub").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).select("hub", blocks("rows", "shingles").alias("parts"))
    sizes = stage(sizes, "star-sizes")
    rays = stars.join(sizes, "hub").select(F.xxhash64("hub", F.pmod(F.xxhash64("cls"), "parts").cast("int")).alias("group"), "cls", F.lit(False).alias("low"))
    centres = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.xxhash64("hub", "part").alias("group"), F.col("hub").alias("cls"), F.lit(True).alias("low"))
    rows = rays.unionByName(centres).withColumns({"label": F.col("cls"), "own": F.lit(False), "group_key": F.lit(0).cast("long")})
    links = stage(compare(rows, members, width, percent, banded=False), "links")
    roots = components(links)

    # second round: whatever lies between components
    labelled = at.withColumn("label", F.col("cls")) if roots is None else at.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("root", "cls")).drop("root")
    labelled = stage(labelled.select("key", "cls", "n", "label"), "labelled")
    parts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    several = parts.groupBy("key").agg(F.max(F.struct("rows", "shingles", "label")).alias("main"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    several = several.select("key", F.col("main.label").alias("main"), "rows", "shingles", F.col("main.rows").alias("main_rows"), F.col("main.shingles").alias("main_shingles"), (F.col("rows") - F.col("main.rows")).alias("other_rows"), (F.col("shingles") - F.col("main.shingles")).alias("other_shingles"))
    single, minor, major = blocks("rows", "shingles"), blocks("other_rows", "other_shingles"), blocks("main_rows", "main_shingles")
    several = stage(several.select("key", "main", (single == 1).alias("single"), minor.alias("minor"), major.alias("major")), "several")
    opened = labelled.join(several, "key")
    # blocks 0 .. minor - 1 hold the others, the rest the largest component, which meets the others alone
    other = F.col("label") != F.col("main")
    place = F.pmod(F.xxhash64("cls"), F.when(other, F.col("minor")).otherwise(F.col("major")))
    opened = opened.withColumn("block", F.when(F.col("single"), 0).when(other, place).otherwise(F.col("minor") + place).cast("int"))
    last = F.when(F.col("single"), 0).when(other, F.col("minor") + F.col("major") - 1).otherwise(F.col("minor") - 1)
    opened = opened.withColumn("with", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    rows = opened.select(F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with")).alias("group"), "cls", "label", (F.col("block") < F.col("with")).alias("low"), (F.col("block") == F.col("with")).alias("own"), F.col("key").alias("group_key"))
    more = stage(compare(rows, members, width, percent, banded=True), "more-links")
    joined = components(more)
    for done in (at, degree, members, stars, sizes, links, labelled, several, more):
        unstage(done)
    if roots is None or joined is None:
        return joined if roots is None else roots
    onto = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    alone = joined.join(roots.select("node"), "node", "left_anti")  # classes that only the second round links
    return stage(roots.join(onto, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(alone), "roots")


def judge(docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """For every row: doc_id, row_key, n_shingles, component_id, kept, first (whether it has the doc_id and row_key of its component's first)."""
    text_batches(docs.sparkSession)
    sketched = stage(sketch_documents(docs, width, percent, doc_id, text), "sketches")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))  # ids that are null come last
    classes = sketched.where("d1 is not null").groupBy("d1", "d2").agg(best.alias("best"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("cls"), "d1", "d2", "n", "registers", "best.doc_id", "best.row_key"), "classes")
    texts = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    roots = find_roots(classes, texts, bands_of(classes), width, percent)
    rooted = classes.select("cls", "d1", "d2", "doc_id", "row_key")
    if roots is not None:
        whole = rooted.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        joined = whole.where("root is not null")
        firsts = joined.groupBy("root").agg(best.alias("best"))
        rooted = stage(joined.select("d1", "d2", "root").join(firsts, "root").select("d1", "d2", "best.doc_id", "best.row_key").unionByName(whole.where("root is null").select("d1", "d2", "doc_id", "row_key")), "rooted")
    of_set = rooted.select("d1", "d2", F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"))
    rows = sketched.where("d1 is not null").select("doc_id", "row_key", "n_shingles", "d1", "d2").join(of_set, ["d1", "d2"])
    rows = rows.select("doc_id", "row_key", "n_shingles", F.col("_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key"))).alias("first"))
    empty = sketched.where("d1 is null").select("doc_id", "row_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("boolean").alias("first"))
    return rows.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def decide(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, row_key, n_shingles, component_id, kept."""
    return judge(docs, width, percent, doc_id, text).drop("first")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every component, with docs' columns, and every row without words: of rows that share the least doc_id, that with the least hash."""
    judged = judge(docs, width, percent, doc_id, text)
    return keep_rows(docs, F.col(doc_id), row_key(doc_id, text), judged.select(F.col("doc_id").alias("id"), F.col("row_key").alias("key"), F.coalesce("first", F.lit(True)).alias("keep"), F.col("first").isNull().alias("always")))
