"""Language identification with string kernels.

A text's features are the 1- to 3-grams of its lower-cased letters (other characters count as one blank) that are present,
hashed into DIM bits: a blended-spectrum presence kernel, normalised to 1 for equal sets. Nystroem landmarks, the same
number for each language, give a small basis; a kernel ridge regression for each language against the rest is fitted in it on
the driver. Whole batches are scored by two matrix products.

The fit sees at most `per_language` rows of each language, those with the smallest seeded hashes; it gets their bits, not
their texts. Everything else covers all rows and whole texts.

Cases: a null text, one without letters, or a fit without any labelled row gives `und` with score 0; ties go to the first language in
order; rows that repeat are each predicted; an empty table gives no rows; extra columns are kept by `keep_known` alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.kernels import slices
from ferrule.llm.staging import text_batches

DIM = 4096
PARTS = 64
UNKNOWN = "und"
_LETTERS = np.fromiter((chr(i).isalpha() and not 0xD800 <= i < 0xE000 for i in range(0x110000)), bool, 0x110000)
_FACTORS = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of DIM booleans for every text, and whether it has a letter."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(lowered)), sizes)
    letter = _LETTERS[points]
    out = np.zeros((len(lowered), DIM), bool)
    lettered = np.bincount(row[letter], minlength=len(lowered)) > 0
    unit = np.where(letter, points, 32).astype(np.uint32)
    gram = np.zeros(len(unit), np.uint32)
    for n in range(3):
        if len(unit) <= n:
            break
        m = len(unit) - n
        gram = (gram[:m] + unit[n:]) * _FACTORS[n]
        gram ^= gram >> np.uint32(15)
        same = row[:m] == row[n:]
        out[row[:m][same], (gram[same] * np.uint32(2246822507) >> np.uint32(20)).astype(np.int64)] = True
    return out, lettered


def _unit(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) / np.sqrt(np.maximum(x.sum(1, dtype=np.float32), 1))[:, None]


@dataclass(frozen=True)
class Model:
    """Languages, landmarks (rows of unit length), and the regressions' coefficients on kernels with the landmarks; the last row is the constant."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, bits: np.ndarray) -> np.ndarray:
        """A number from 0 to 1 for every row and language; a row's sum is 1."""
        kernels = _unit(bits) @ self.landmarks.T
        got = kernels @ self.weights[:-1] + self.weights[-1]
        e = np.exp(6 * (got - got.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def fit_bits(bits: np.ndarray, languages: list[str], landmarks: int = 64, ridge: float = 1e-3) -> Model:
    """One-versus-rest kernel ridge regression in the Nystroem basis of `landmarks` rows of each language."""
    names = sorted(set(languages))
    which = np.array([names.index(x) for x in languages])
    x = _unit(bits)
    z = x[np.concatenate([np.flatnonzero(which == k)[:landmarks] for k in range(len(names))])]
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.hstack([(x @ z.T) @ root, np.ones((len(x), 1))])
    share = np.bincount(which, minlength=len(names)) / len(which)
    weight = (1 / share)[which] / len(names)
    y = np.where(which[:, None] == np.arange(len(names)), 1.0, -1.0)
    penalty = ridge * len(x) * np.eye(phi.shape[1])
    penalty[-1, -1] = 0
    solved = np.linalg.solve((phi * weight[:, None]).T @ phi + penalty, (phi * weight[:, None]).T @ y)
    return Model(names, z, np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32))


def fit(labelled: DataFrame, per_language: int = 500, key: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = 1) -> Model | None:
    """Learns from labelled rows with text and language; None if there are none."""
    order = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    ranked = rows.select(F.col(lang).alias("lang"), order.alias("o"))
    # a hash of the order deals each language out to PARTS tasks, of which each passes on per_language rows at most
    some = ranked.withColumn("part", F.pmod("o", F.lit(PARTS))).withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy("o"))).where(F.col("n") <= per_language)
    chosen = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o"))).where(F.col("n") <= per_language).select("lang", "o").distinct()  # per_language rows of each language at most
    picked = rows.select(F.col(lang).alias("lang"), order.alias("o"), F.col(text).alias("text")).join(F.broadcast(chosen), ["lang", "o"], "left_semi").dropDuplicates(["lang", "o"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", rows=512):
                bits, lettered = presence(b.column("text").to_pylist())
                packed = [row.tobytes() for row in np.packbits(bits, axis=1)]
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("o"), pa.array(packed, pa.binary()), pa.array(lettered)], ["lang", "o", "bits", "lettered"])

    got = picked.mapInArrow(run, "lang string, o long, bits binary, lettered boolean").where("lettered").orderBy("o", "lang").collect()
    if not got:
        return None
    return fit_bits(np.unpackbits(np.frombuffer(b"".join(r.bits for r in got), np.uint8).reshape(len(got), -1), axis=1), [r.lang for r in got])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score in place of the text's column, from the text alone."""
    text_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    renamed = [f"_{i}" for i in range(len(kept))]  # whatever the columns are called, none has the name of the text's
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text", rows=512):
                bits, lettered = presence(b.column("_text").to_pylist())
                names, best = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
                if model is not None and lettered.any():
                    scores = model.scores(bits[lettered])
                    for i, k, v in zip(np.flatnonzero(lettered), scores.argmax(1), scores.max(1), strict=True):
                        names[i], best[i] = model.languages[k], v
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in renamed], pa.array(names, pa.string()), pa.array(best)], schema.names)

    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, renamed, strict=True)], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Whether a row is in the fold that the fit never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_known(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs whose language is recognised, with docs' columns."""
    names = docs.columns
    marked = predict(docs.withColumn("_whole", F.struct(*[F.col(f"`{c}`") for c in names])).select("_whole", F.col(f"`{text}`").alias("_t")), model, "_t")
    return marked.where(F.col("lang_pred") != UNKNOWN).select("_whole.*")
