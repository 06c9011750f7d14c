"""Many strings at once, sinks with reports, lines that can't be read, files by extension: against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ferrule.functions import temporal
from ferrule.operators import patterns
from ferrule.sources import files


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("block", [3, 1000])
def test_strings_by_brute_force(spark, whole, block):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choices("ab_ é日😀", k=rng.randrange(0, 60)))) for i in range(80)] + [(100, None), (101, "aaaa"), (102, "x aa aa_ aa")]
    strings = [t[k : k + n] for _, t in texts[:30] if t for k, n in [(rng.randrange(0, 40), rng.randrange(1, 4))]] + ["aa", "aa", "", None, "never there"]
    want = set()
    for i, t in texts:
        for s in set(strings) - {"", None}:
            at = [k for k in range(len(t or "") - len(s) + 1) if t[k : k + len(s)] == s]
            wordy = lambda c: c.isalnum() or c == "_"
            at = [k for k in at if not whole or not (k and wordy(t[k - 1]) or k + len(s) < len(t) and wordy(t[k + len(s)]))]
            if at:
                want.add((i, s, len(at), at[0] + 1))
    df, sought = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(s,) for s in strings], "term string")
    got = patterns.find(df, "doc_id", "text", sought, "term", whole=whole, block=block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert patterns.find(df, "doc_id", "text", sought.limit(0), "term").collect() == []


def test_reports_come_with_the_write(spark, tmp_path):
    rows = [(1, "a"), (2, None), (3, ""), (4, "long text"), (5, "xx"), (None, "y")]
    df = spark.createDataFrame(rows, "id long, text string")
    report = {r.reason: r.rows for r in files.write_reported(df, str(tmp_path / "out"), {"empty": "text is null or text = ''", "short": "length(text) < 2", "never": "id > 99"}).collect()}
    assert report == {"read": 6, "empty": 2, "short": 2, "never": 0, "written": 2}
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "out")).collect()) == [4, 5]
    assert {r.rows for r in files.write_reported(df.limit(0), str(tmp_path / "none"), {"empty": "text = ''"}).collect()} == {0}


def test_lines_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "text": "x"}\n{"id": "no", "text": "y"}\nnot json\n')
    rows = files.read_checked(spark, str(tmp_path), "id long, text string").cache()
    assert rows.where("corrupt is null").select("id", "text").collect() == [(1, "x")]
    assert sorted(r.corrupt for r in rows.where("corrupt is not null").collect()) == ["not json", '{"id": "no", "text": "y"}']


def test_documents_by_extension(spark, tmp_path):
    for name in ("a.pdf", "b.TXT", "sub/c.html", "d.exe", "e.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.list_documents(spark, str(tmp_path)).collect()) == ["a.pdf", "b.TXT", "c.html"]


@pytest.mark.parametrize(
    "text, day, source",
    [
        ("as on 31/12/2019?", "2019-12-31", "explicit"),
        ("on 5-3-69 or 1 May 2000", "2069-03-05", "explicit"),
        ("on 5-3-70", "1970-03-05", "explicit"),
        ("31/02/2020", "2020-02-28", "explicit"),
        ("by 3 sept 2001", None, None),
        ("by 3 Sep 2001", "2001-09-03", "explicit"),
        ("30  FEBRUARY 1999", "1999-02-28", "explicit"),
        ("in 1947", "1947-12-31", "inferred_year"),
        ("BNS, 2023", "2024-07-01", "acts_inference"),
        ("in 2023", "2023-12-31", "inferred_year"),
        ("room 1066", "2025-01-01", "default"),
        ("", "2025-01-01", "default"),
        ("5/13/2020", None, "explicit"),
    ],
)
def test_query_dates(spark, text, day, source):
    got = spark.createDataFrame([(text,)], "q string").select(temporal.query_context(F.col("q"), F.lit("2025-01-01").cast("date")).alias("c")).first().c
    if source is None:  # no such month name: the year alone
        day, source = "2001-12-31", "inferred_year"
    assert (got.day, got.source) == (day and dt.date.fromisoformat(day), source)
