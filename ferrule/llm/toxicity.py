"""Toxicity as a severity grade, by cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(w.x - theta_k) with one weight vector w for all ordered thresholds theta_1 < theta_2. x marks which
words (A-Z lower-cased, split at ASCII signs, hashed) and beginnings of words a text has. The output is the expected severity, the sum over k of P(grade > k).

Labels say only toxic or not, so grades come in two steps: a first fit with one threshold finds the words that speak for toxicity;
toxic rows whose share of such words is above the median get grade 2, other toxic rows grade 1, the rest 0.

The fit sees at most `most` labelled rows, those with the smallest seeded hashes of their ids, and of the words the `SCREEN` whose presence
differs most between the classes. Everything else covers all rows and whole texts.

Cases: a null or empty text has no words and gets the severity of the thresholds alone; several labels of a row count as toxic
if one does; a null label is left out; without labels of both kinds every severity is 0; ties in hash order are broken by id; rows that repeat are
each scored; an empty table gives no rows; extra columns aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.kernels import LOWER, buffers, slices, span_hashes, words
from ferrule.llm.staging import text_batches

BITS = 22
SCREEN = 8000
#: Lengths in bytes of the beginnings of words that count as features beside the words.
STEMS = (4, 5, 6)
_WORDY = np.zeros(256, bool)
_WORDY[48:58] = _WORDY[65:91] = _WORDY[97:123] = _WORDY[128:] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word features of every text, bounds of each text's, and each text's number of words."""
    data, offsets = buffers(column)
    data = LOWER[data]
    cut = np.where(_WORDY[data], data, np.uint8(32))
    starts, ends, row = words(cut, offsets)
    size = ends - starts
    made = [(row << BITS) | (span_hashes(cut, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)]
    for k in STEMS:  # the stem counts apart from the same letters as a whole word
        longer = size > k
        made.append((row[longer] << BITS) | (span_hashes(cut, starts[longer], starts[longer] + k) * np.uint64(2 * k + 1) >> np.uint64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(made))
    n = len(column)
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(n + 1)), np.bincount(row, minlength=n)


@dataclass(frozen=True)
class Model:
    """Sorted features with their weights, and the thresholds in ascending order."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def linear(self, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.zeros(len(bounds) - 1)
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        w = np.where(self.features[at] == found, self.weights[at], 0.0)
        total = np.concatenate(([0.0], np.cumsum(w)))
        return total[bounds[1:]] - total[bounds[:-1]]

    def exceed(self, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(grade > k) for every row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.linear(found, bounds)[:, None], -60, 60)))


def _cumulative_fit(rows: np.ndarray, cols: np.ndarray, n: int, m: int, grade: np.ndarray, levels: int, l1: float, rounds: int = 400, pull: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Proximal accelerated gradient on the mean negative log likelihood of the grades, with an L1 penalty on the shared weights, none of which is negative: a long text's clean words don't make up for its toxic ones.

    Each round draws the k-th threshold up by k * pull, a prior that higher grades are rarer, with which held-out recall is better on few rows."""
    w, theta = np.zeros(m), np.linspace(0.5, 1.5, levels)
    weight = np.where(grade > 0, np.sqrt((grade == 0).sum() / max((grade > 0).sum(), 1)), 1.0)[:, None]
    scale = 1 / np.sqrt(np.bincount(cols, minlength=m) / n + 1e-3)  # rare features move as fast as frequent ones
    v = np.ones(m)
    for _ in range(12):  # the largest curvature
        v = scale * np.bincount(cols, weights=(np.bincount(rows, weights=(scale * v)[cols], minlength=n) * weight[:, 0])[rows], minlength=m) / n
        top = np.linalg.norm(v)
        v /= top
    vw, vt, step, momentum = w.copy(), theta.copy(), 2 / top, 1.0

    def slope(w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.bincount(rows, weights=(scale * w)[cols], minlength=n)[:, None] - theta
        p = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(z, -40, 40))), np.zeros((n, 1))])
        own = np.maximum(p[np.arange(n), grade] - p[np.arange(n), grade + 1], 1e-9)
        d = p * (1 - p)
        dz = np.zeros((n, levels + 2))
        dz[np.arange(n), grade] -= d[np.arange(n), grade] / own
        dz[np.arange(n), grade + 1] += d[np.arange(n), grade + 1] / own
        inner = dz[:, 1:-1] * weight
        return scale * np.bincount(cols, weights=inner.sum(1)[rows], minlength=m) / n, -inner.sum(0) / n

    for _ in range(rounds):
        gw, gt = slope(vw, vt)
        nw = np.maximum(vw - step * (gw + l1), 0)
        nt = np.maximum.accumulate(vt - step * gt + pull * np.arange(levels))
        nm = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        vw, vt = nw + (momentum - 1) / nm * (nw - w), nt + (momentum - 1) / nm * (nt - theta)
        w, theta, momentum = nw, nt, nm
    return scale * w, theta


def fit_rows(found: list[np.ndarray], toxic: np.ndarray, sizes: np.ndarray, l1: float = 2e-2) -> Model:
    """The model of bounded, collected rows: features present, label, and number of words of each."""
    n = len(found)
    if not n or toxic.all() or not toxic.any():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(2, 60.0))
    rows, cols = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in found]), np.concatenate(found).astype(np.int32)
    names = np.unique(cols)
    cols = np.searchsorted(names, cols).astype(np.int32)
    names = names.astype(np.int64)
    with_, yes = np.bincount(cols), np.bincount(cols, weights=toxic[rows].astype(float))
    share, base = (yes + 0.5 * toxic.mean()) / (with_ + 0.5), toxic.mean()
    gain = np.abs(share - base) * np.sqrt(with_)
    kept = np.sort(np.argsort(-gain, kind="stable")[:SCREEN])
    place = np.full(len(names), -1)
    place[kept] = np.arange(len(kept))
    use = place[cols] >= 0
    rows, cols, names = rows[use], place[cols[use]], names[kept]
    w, _ = _cumulative_fit(rows, cols, n, len(names), toxic.astype(int), 1, l1)
    dense = np.bincount(rows, weights=(w > 0.1)[cols].astype(float), minlength=n) / np.maximum(sizes, 1)
    grade = np.where(toxic, 1 + (dense > np.median(dense[toxic])), 0)
    w, theta = _cumulative_fit(rows, cols, n, len(names), grade, 2, l1)
    used = np.flatnonzero(w)
    return Model(names[used], w[used], theta)


def fit(docs: DataFrame, labels: DataFrame, most: int = 12_000, key: str = "doc_id", text: str = "text", label: str = "toxic", seed: int = 1) -> Model:
    """Learns from at most `most` labelled rows."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.max(label) > 0).alias("_toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "_key"), "_key").limit(most)
    picked = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key").groupBy("_key", "_toxic").agg(F.min("text").alias("text"))  # of a repeated id the least text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                found, bounds, sizes = features(b.column("text"))
                made = [found[x:y].astype(np.int32).tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_toxic"), pa.array(made, pa.binary()), pa.array(sizes)], ["_key", "_toxic", "found", "n"])

    schema = T.StructType([picked.schema["_key"], picked.schema["_toxic"], T.StructField("found", T.BinaryType()), T.StructField("n", T.LongType())])
    got = picked.mapInArrow(run, schema).orderBy("_key").collect()  # `most` rows at most
    return fit_rows([np.frombuffer(r.found, np.int32) for r in got], np.array([r._toxic for r in got], bool), np.array([r.n for r in got]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, severity (expected grade, 0 to 2), grade (the likeliest), toxic (whether a grade above 0 is likelier than not)."""
    text_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[key], T.StructField("severity", T.DoubleType()), T.StructField("grade", T.LongType()), T.StructField("toxic", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text"):
                found, bounds, _ = features(b.column("_text"))
                p = model.exceed(found, bounds)
                each = np.hstack([np.ones((len(p), 1)), p]) - np.hstack([p, np.zeros((len(p), 1))])
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int64)), pa.array(p[:, 0] >= 0.5)], schema.names)

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)
