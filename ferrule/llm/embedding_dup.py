"""Near-duplicate vectors by iterative quantisation (ITQ) and multi-index Hamming tables.

ITQ learns, on a bounded sample, rotations of the principal components whose signs are balanced binary codes. Each table is keyed by
`bits` of a code's bits. There are so many tables (over several rotations) that of close pairs, the sample's own and ones made at the
threshold, at least RECALL share a key; this is measured. Codes are taken round the sample's mean, or round zero if a group or a
direction that many vectors share lies so near the mean that its members' codes would differ too much. Vectors that share a table's key are
compared by the cosine of their original components in double precision; sums within rounding of the threshold are taken exactly.

Vectors of each length are a table of their own. Equal vectors are one class from the start. Buckets of more than BLOCK classes are compared block by block, each pair of blocks apart from the others, so no
task gets a whole bucket. A link that several tables find is counted by the first alone, and from each group only counts
and a spanning forest leave, never its pairs.

The fit sees at most `sample` different vectors, those with the smallest seeded hashes.

Cases: vectors that are null, empty or zero, or hold null or non-finite components link with nothing, and vectors of different lengths don't link with each other; rows that repeat link with each other; an empty table gives no rows; other columns aren't used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.graph import components
from ferrule.llm.staging import stage, unstage

RECALL = 0.98
BLOCK = 4096
DENSE = 64


def itq(x: np.ndarray, mean: np.ndarray, width: int, rounds: int = 30, seed: int = 1) -> Iterator[np.ndarray]:
    """One learnt projection of x - mean to `width` signs after another."""
    v = x - mean
    values, vectors = np.linalg.eigh(v.T @ v)
    basis = vectors[:, np.argsort(-values)[:width]]
    v = v @ basis
    rng = np.random.default_rng(seed)
    while True:
        r = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        yield basis @ r


def tables(bits: int, cosine: float) -> int:
    """Number of tables of `bits` bits, if a pair at the cosine agrees in a bit as often as its angle says."""
    agree = 1 - np.arccos(cosine) / np.pi
    return int(np.ceil(np.log(1 - RECALL) / np.log(1 - agree**bits)))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def close_pairs(x: np.ndarray, cosine: float, most: int = 2000, seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs just above the cosine, by kind: of the sample's own (if there are enough to tell), and made from it at the cosine, towards other vectors of the sample and anywhere."""
    rng, left, right = np.random.default_rng(seed), [], []
    for k in range(0, len(x), 500):
        s = x[k : k + 500] @ x.T
        p, q = np.nonzero((s >= cosine) & (s < cosine + 0.02))
        p, q = p[q > p + k] + k, q[q > p + k]
        some = rng.permutation(len(p))[:most]
        left.append(p[some])
        right.append(q[some])
    p, q = np.concatenate(left), np.concatenate(right)
    some = rng.permutation(len(p))[:most]
    out = [(x[p[some]], x[q[some]])] if len(some) >= 50 else []
    for towards in (x[rng.integers(0, len(x), most)], rng.standard_normal((most, x.shape[1]))):
        a = x[rng.integers(0, len(x), most)]
        d = towards - (a * towards).sum(1, keepdims=True) * a
        size = np.linalg.norm(d, axis=1)
        a, d = a[size > 1e-6], d[size > 1e-6] / size[size > 1e-6, None]
        if len(a):
            out.append((a, cosine * a + np.sqrt(1 - cosine**2) * d))
    return out


def learn(x: np.ndarray, rows: int, cosine: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Mean, projections (a column for each bit of each table), bits of a table's key (at first a few more than log2 of the rows) and number of
    tables, so many that of each kind of close pairs at least RECALL share a key. Where codes round the mean would need over twice the tables that
    the angles ask for, as in a group that makes up much of the sample, the mean isn't subtracted; where that isn't enough, keys get shorter."""
    dim = x.shape[1]
    width = min(dim, 64)
    kinds = close_pairs(x, cosine)
    for bits in range(int(min(max(8, np.ceil(np.log2(max(rows, 2))) + 3), 28, dim)), 0, -1):
        least = tables(bits, cosine)
        per = width // bits
        for mean, most in ((x.mean(0), 2 * least), (np.zeros(dim), 4 * least)):
            made, count = [], 0
            met = [np.zeros(len(a), bool) for a, _ in kinds]
            for planes in itq(x, mean, width):
                sides = [((a - mean) @ planes > 0) == ((b - mean) @ planes > 0) for a, b in kinds]
                for k in range(per):
                    at = np.arange(k, per * bits, per)
                    made.append(planes[:, at])
                    met = [m | s[:, at].all(1) for m, s in zip(met, sides, strict=True)]
                    count += 1
                    enough = count >= least and all(m.mean() >= RECALL for m in met)
                    if enough or count == most:
                        break
                if enough or count == most:
                    break
            if enough:
                return mean, np.hstack(made), bits, count
    return np.zeros(dim), np.zeros((dim, 0)), 0, 1  # one bucket


def scaled(v: np.ndarray) -> np.ndarray:
    """Every row times a power of 2, which changes no bit of a cosine's sums, so that its largest component is about 1."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def at_least(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the cosine of each row of a with b's is at least the given one; sums are exact before they are rounded."""
    out = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        out[i] = math.sumprod(x, y) / (math.sqrt(math.sumprod(x, x)) * math.sqrt(math.sumprod(y, y))) >= cosine
    return out


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut where a group ends; groups come one after another."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column("group").to_numpy()
        if held and held[-1].column("group")[-1].as_py() != g[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = 0 if g[0] == g[-1] else int(np.flatnonzero(g != g[-1])[-1]) + 1
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def close(g: np.ndarray, side: np.ndarray, own: np.ndarray, u: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, of its two sides or both of its own block, whose unit vectors u have a product of at least `least`.

    Small groups are taken together, rows and their k-th next ones at a time; large ones by products of matrices.
    """
    bounds = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    sizes = np.diff(bounds)
    a, step = np.flatnonzero(np.repeat(sizes <= DENSE, sizes)), 0
    while len(a):
        step += 1
        a = a[a < len(g) - step]
        a = a[g[a] == g[a + step]]
        use = a[own[a] | (side[a] != side[a + step])]
        near = np.einsum("ij,ij->i", u[use], u[use + step]) >= least
        yield use[near], use[near] + step
    for k in np.flatnonzero(sizes > DENSE):
        rows = np.arange(bounds[k], bounds[k + 1])
        left = rows if own[rows[0]] else rows[side[rows] == side[rows[0]]]
        right = rows if own[rows[0]] else rows[side[rows] != side[rows[0]]]
        for i in range(0, len(left), 512):
            p, q = np.nonzero(u[left[i : i + 512]] @ u[right].T >= least)
            p, q = left[i + p], right[q]
            if own[rows[0]]:
                p, q = p[p < q], q[p < q]
            yield p, q


def find_links(vectors: DataFrame, cosine: float = 0.9, sample: int = 5000, key: str = "vec_id", vector: str = "embedding", seed: int = 1) -> DataFrame:
    """key, n_links, component_id (least key reachable, itself included), kept."""
    doubles = F.col(vector).cast("array<double>")
    good = F.coalesce(F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubles, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("id"), F.when(good, doubles).alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = stage(rows, "vectors")
    out = rows.where("v is null").select(F.col("id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    lengths = [r.n for r in rows.where("v is not null").groupBy(F.size("v").alias("n")).count().collect()]  # a row for each length
    for dim in sorted(lengths):
        out = out.unionByName(_of_length(rows.where(F.size("v") == dim), dim, cosine, sample, seed))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _of_length(used: DataFrame, dim: int, cosine: float, sample: int, seed: int) -> DataFrame:
    """id, n_links and component_id for rows (id, v, row) with vectors of dim components."""
    classes = stage(used.groupBy("v").agg(F.min("row").alias("cls"), F.count(F.lit(1)).alias("weight")), "classes")
    fitted = classes.orderBy(F.xxhash64(F.lit(seed), "v"), "cls").limit(sample).select("v").collect()
    mean, planes, bits, count = learn(unit(np.array([r.v for r in fitted])), classes.count(), cosine)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.array(b.column("v").flatten()).reshape(b.num_rows, dim)
            codes = (((unit(v) - mean) @ planes > 0).reshape(len(v), count, bits) @ powers).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("weight"), pa.array([r.tobytes() for r in scaled(v)], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) * count + 1, count), pa.int32()), pa.array(codes.ravel()))], ["cls", "weight", "scaled", "codes", "keys"])

    coded = stage(classes.mapInArrow(encode, "cls long, weight long, scaled binary, codes binary, keys array<int>"), "codes")
    at = coded.select("cls", F.posexplode("keys").alias("table", "key"))
    shared = at.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    members = at.join(shared, ["table", "key"]).withColumn("block", F.pmod(F.xxhash64("cls"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.select("cls", "table", "block", F.xxhash64("table", "key", F.least("block", "other"), F.greatest("block", "other")).alias("group"), (F.col("block") == F.col("other")).alias("own"))
    full = members.join(coded.drop("keys"), "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            cls, weight, table = t["cls"].to_numpy(), t["weight"].to_numpy(), t["table"].to_numpy()
            v = _vectors(t["scaled"])
            u = v / np.linalg.norm(v, axis=1, keepdims=True)
            codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.int32).reshape(len(v), -1)
            links, root = np.zeros(len(v), np.int64), np.arange(len(v))
            for p, q in close(t["group"].to_numpy(), t["block"].to_numpy(), t["own"].to_numpy(), u, cosine - 1e-9):
                for k in range(0, len(p), 1 << 16):
                    x, y = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                    s = np.einsum("ij,ij->i", u[x], u[y])
                    sure = s >= cosine + 1e-9
                    sure[~sure] = at_least(v[x[~sure]], v[y[~sure]], cosine)
                    x, y = x[sure], y[sure]
                    first = (codes[x] == codes[y]).argmax(1) == table[x]
                    np.add.at(links, x[first], weight[y[first]])
                    np.add.at(links, y[first], weight[x[first]])
                    while (root[x] != root[y]).any():  # the least row of each row's component in this part
                        low = np.minimum(root[x], root[y])
                        np.minimum.at(root, root[x], low)
                        np.minimum.at(root, root[y], low)
                        root = root[root]
            while (root != root[root]).any():
                root = root[root]
            told = (links > 0) | (root != np.arange(len(v)))
            yield pa.RecordBatch.from_arrays([pa.array(cls[told]), pa.array(links[told]), pa.array(cls[root[told]])], ["cls", "links", "root"])

    dealt = full.repartition("group").sortWithinPartitions("group", "cls")
    found = stage(dealt.mapInArrow(compare, "cls long, links long, root long"), "links")
    unstage(coded)
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    of_class = classes.join(counts, "cls", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    of_class = of_class.withColumn("root", F.col("cls")) if roots is None else of_class.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = used.join(of_class.select("v", "weight", "links", "root"), "v").select("id", "row", (F.col("links") + F.col("weight") - 1).alias("n_links"), "root")
    lowest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return named.join(lowest, "root").select("id", "n_links", "component_id")
