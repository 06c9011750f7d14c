"""Machines and upserts on streams: rows out of order, several files, a restart from the checkpoint, a replayed batch."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ferrule.streaming import machines

EVENTS = "user_id long, event_id long, ts timestamp, value double, starts boolean"
BASE = dt.datetime(2024, 1, 1)


@pytest.fixture
def files(spark, tmp_path):
    """Four files of events, in order of time but for a shuffle of a few minutes, the last one far later."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        at = i * 45 + rng.randrange(300)
        rows.append((rng.choice([1, 2, 3]), i, BASE + dt.timedelta(seconds=at), rng.choice([1.0, 30.0, 30.0]), rng.random() < 0.6))
    rows += [(None, 900, BASE, 1.0, True), (1, None, BASE, 1.0, True), (2, 901, None, 1.0, True)]
    parts = [rows[k : k + 101] for k in range(0, len(rows), 101)] + [[(9, 999, BASE + dt.timedelta(days=2), 1.0, False)]]

    def write(k):
        spark.createDataFrame(parts[k], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return rows, write, len(parts), tmp_path


def plain(rows, starts, machine):
    out = []
    for user in {r[0] for r in rows} - {None}:
        state = None
        for _, event, ts, value, mark in sorted((r for r in rows if r[0] == user and r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[1])):
            state, told = machine.step(state, (round((ts - BASE).total_seconds() * 1e6), event, mark if starts else value > 20))
            if told:
                out.append((user, *told))
    return sorted(out)


@pytest.mark.parametrize("starts", [False, True])
def test_machines_over_a_restart(spark, files, starts):
    rows, write, parts, path = files
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    run = lambda: machines.drain(machines.timers(stream(), F.col("starts")) if starts else machines.alerts(stream(), F.col("value") > 20, 120_000_000), str(path / "out"), str(path / "at"))
    for k in range(parts // 2):
        write(k)
    first = run().count()
    for k in range(parts // 2, parts):
        write(k)
    got = sorted(tuple(r) for r in run().collect())
    want = plain(rows, starts, machines.Timers() if starts else machines.Alerts(120_000_000))
    assert got == want and 0 < first < len(got)


def test_a_replayed_batch_changes_nothing(spark, files):
    rows, write, parts, path = files
    for k in range(parts):
        write(k)
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    machines.upsert_stream(stream(), str(path / "table"), str(path / "at"))
    table = lambda: {r.user_id: r for r in machines.current(spark, str(path / "table"), ["user_id"], ["ts", "event_id"]).collect()}
    before = table()
    commits = sorted((path / "at" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in [commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")]:  # the last batch was written, but not committed
        p.unlink(missing_ok=True)
    machines.upsert_stream(stream(), str(path / "table"), str(path / "at"))
    assert table() == before and len(before) == 5
