"""URL rules in a sorted digest array.

The rules' 64-bit xxhash keys are sorted into a file that every executor fetches once and maps into memory; the rules'
strings lie beside it. A url gives one key for each suffix of its host and each length of path that occurs among the
rules, longest first. All keys of a batch are sought by one vectorised binary search, and a hit counts only when the
stored string is the same, so collisions do no harm.

Cases: a null url or one without `://` has empty host and path and meets no rule; the longest matching rule wins, by characters
of host and path together, then by host; with no rule the verdict is the default; repeated rows are each judged; an empty
table gives no rows; other columns are kept out of the result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.exact_dedup import ascii_lower


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty where it has none."""
    got = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(got(1)), got(2)


def write_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> tuple[str, list[int]]:
    """Sorted keys, string bounds, verdicts and strings of (verdict, host, path) rules, handed to every executor. Returns the files' name and the lengths of the rules' paths."""
    rows = sorted((xxhash.xxh64_intdigest(f"{host}{path}".encode()), f"{host}{path}".encode(), verdict == "allow") for verdict, host, path in rules)
    texts = np.cumsum([0] + [len(r[1]) for r in rows], dtype=np.int64)
    name = f"rules-{uuid.uuid4().hex}"
    own = tempfile.mkdtemp(prefix="rules-")  # on the driver, which hands the files out for as long as the session lasts
    for kind, data in (("keys", np.array([r[0] for r in rows], np.uint64)), ("ends", texts), ("allow", np.array([r[2] for r in rows], np.uint8)), ("text", np.frombuffer(b"".join(r[1] for r in rows), np.uint8))):
        path = str(Path(own, f"{name}.{kind}.npy"))
        np.save(path, data)
        spark.sparkContext.addFile(path)
    return name, sorted({len(path) for _, _, path in rules}, reverse=True)


@lru_cache(maxsize=4)
def _mapped(name: str) -> dict[str, np.ndarray]:
    kinds = {"keys": np.uint64, "ends": np.int64, "allow": np.uint8, "text": np.uint8}
    return {k: np.load(SparkFiles.get(f"{name}.{k}.npy"), mmap_mode="r") for k in kinds}


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule (null if none fits) and verdict of every row."""
    name, lengths = write_rules(urls.sparkSession, rules)
    host, path = url_parts(F.col(url))
    parts = urls.select(F.col(key).alias(key), host.alias("host"), path.alias("path"))
    schema = T.StructType([*parts.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _mapped(name)
        keys, ends, allow, text = (table[k] for k in ("keys", "ends", "allow", "text"))
        for batch in batches:
            row, tried = [], []
            for i, (h, p) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                if h:
                    at = 0
                    while True:
                        for n in lengths:
                            if len(p) >= n:
                                row.append(i)
                                tried.append(h[at:] + p[:n])
                        at = h.find(".", at) + 1
                        if not at:
                            break
            best: dict[int, tuple[int, str, bool]] = {}
            if len(keys) and tried:
                probes = np.fromiter((xxhash.xxh64_intdigest(x.encode()) for x in tried), np.uint64, len(tried))
                place = np.searchsorted(keys, probes)
                for k in np.flatnonzero((place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == probes)):
                    at, want = int(place[k]), tried[k].encode()
                    while at < len(keys) and keys[at] == probes[k]:  # confirm by the stored string
                        if text[ends[at] : ends[at + 1]].tobytes() == want:
                            i = row[k]
                            if i not in best or len(tried[k]) > best[i][0]:
                                best[i] = (len(tried[k]), tried[k], bool(allow[at]))
                            break
                        at += 1
            n = batch.num_rows
            rule = pa.array([best[i][1] if i in best else None for i in range(n)], pa.string())
            verdict = pa.array([("allow" if best[i][2] else "block") if i in best else default for i in range(n)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], schema.names)

    return parts.mapInArrow(run, schema)
