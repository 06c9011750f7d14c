"""Many strings at once: an automaton of all of them passes each text once, however many there are.

Strings are taken in blocks of BLOCK, each a pass over the texts; the texts aren't moved. A block's automaton is built once by each task from the block's strings.

Cases: null and empty strings are found nowhere; a null text has none; overlapping finds all count; with `whole`, a find next to a letter, digit or underscore doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 200_000


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


def find(texts: DataFrame, key: str, text: str, strings: DataFrame, string: str, whole: bool = False, block: int = BLOCK) -> DataFrame:
    """key, string, times, first (place, from 1) of every string in every text that has it. Strings need not be distinct."""
    sought = strings.select(F.col(string).alias("s")).where("s <> ''").distinct()
    blocks = max(1, -(-sought.count() // block))
    rows, kind = texts.select(F.col(key).alias("key"), F.col(text).alias("text")), texts.schema[key].dataType.simpleString()

    def passing(words: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for i, w in enumerate(words):
                machine.add_word(w, i)
            machine.make_automaton()
            for b in batches:
                ids, out = b.column("key").to_pylist(), []
                for k, t in zip(ids, b.column("text").to_pylist(), strict=True):
                    found: dict[int, list[int]] = {}
                    for end, i in machine.iter(t or ""):
                        start = end - len(words[i]) + 1
                        if whole and (start and _wordy(t[start - 1]) or end + 1 < len(t) and _wordy(t[end + 1])):
                            continue
                        found.setdefault(i, [0, start + 1])[0] += 1
                    out += [(k, words[i], n, first) for i, (n, first) in found.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [b.schema.field("key").type, pa.string(), pa.int64(), pa.int64()], strict=True)], ["key", "string", "times", "first"])

        return rows.mapInArrow(run, f"key {kind}, string string, times long, first long")

    parts = []
    for n in range(blocks):
        words = [r[0] for r in sought.where(F.pmod(F.xxhash64("s"), F.lit(blocks)) == n).collect()]  # `block` on average
        if words:
            parts.append(passing(sorted(words)))
    if not parts:
        return rows.limit(0).select(F.col("key").alias(key), F.lit("").alias(string), F.lit(0).cast("long").alias("times"), F.lit(0).cast("long").alias("first"))
    return reduce(DataFrame.unionByName, parts).select(F.col("key").alias(key), F.col("string").alias(string), "times", "first")


def expanded(questions: DataFrame, key: str, text: str, synonyms: DataFrame) -> DataFrame:
    """key, query: each question with the synonyms (term, synonyms) of every term that it contains, each once, after its own text, terms in order."""
    found = find(questions.select(key, F.lower(text).alias("text")), key, "text", synonyms, "term").select(key, "term")
    added = found.join(synonyms, "term").groupBy(key).agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("term", "synonyms"))), lambda x: x["synonyms"]))).alias("added"))
    return questions.select(key, text).join(added, key, "left").select(key, F.concat_ws(" ", F.col(text), F.array_join("added", " ")).alias("query"))
