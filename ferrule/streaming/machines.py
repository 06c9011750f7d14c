"""State machines on streams, in event-time order: alerts that must hold for a while, and timers; and a table that a stream upserts.

Rows of a group wait in list state until the watermark has passed them, are then taken in order of time, and move the group's machine, which lives in value state. So neither late
rows within the watermark nor the cut into micro-batches changes what comes out; what a batch gives for rows that the watermark has passed is what the stream gives. A row is held
for as long as the watermark is behind it, and a group holds nothing else but its machine.

The state store must be RocksDB's, which `ordered` sets in the session. Rows with a null group, time or id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "10 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "user_id long, event_id long, micros long"


class Machine(StatefulProcessor):
    """Takes rows (at in microseconds, event_id, mark) in order; `step` gives the next state (at, event_id or None) and what comes out (event_id, micros or None)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, mark boolean")
        self.state = handle.getValueState("state", "at long, event_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            self.waiting.appendList([(int(a), int(e), bool(m)) for a, e, m in zip(part["at"], part["event_id"], part["mark"], strict=True)])
            first = int(part["at"].min()) if first is None else min(first, int(part["at"].min()))
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        rest = [r for r in rows if r[0] >= passed]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000)  # the watermark isn't there yet
        else:
            self.waiting.clear()
        state, out = tuple(self.state.get()) if self.state.exists() else None, []
        for row in rows[: len(rows) - len(rest)]:
            state, told = self.step(state, row)
            if told:
                out.append((key[0], *told))
        if state:
            self.state.update(state)
        elif self.state.exists():
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "micros"])

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Alerts(Machine):
    """A row at which the condition (mark) has held without a break for `micros` or more, and for how long; a row without it resets the alert."""

    def __init__(self, micros: int):
        self.least = micros

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        at, event, met = row
        if not met:
            return None, None
        since = state or (at, event)
        return since, (event, at - since[0]) if at - since[0] >= self.least else None


class Timers(Machine):
    """A row with mark starts a timer, any other stops it; a second start closes the first. Gives the start's id and how long it ran."""

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        at, event, starts = row
        return (at, event) if starts else None, (state[1], at - state[0]) if state else None


def ordered(events: DataFrame, mark: Column, machine: Machine) -> DataFrame:
    """user_id, event_id, micros from a stream of events (user_id, event_id, ts)."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)
    rows = timed.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"), mark.alias("mark")).where("user_id is not null and event_id is not null and at is not null and mark is not null")
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=machine, outputStructType=OUT, outputMode="Append", timeMode="eventTime")


def alerts(events: DataFrame, met: Column, micros: int) -> DataFrame:
    return ordered(events, met, Alerts(micros))


def timers(events: DataFrame, starts: Column) -> DataFrame:
    return ordered(events, starts, Timers())


def drain(out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there into a table at path; from a checkpoint it goes on where it stood."""
    out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)


def upsert_stream(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Writes each micro-batch into its own folder, by its number. A batch that is replayed after a failure replaces what it wrote, so it changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The table's rows: of each key the last by batch, within a batch by `order`."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch"), *[F.desc(c) for c in order]))
    return spark.read.parquet(path).withColumn("_nth", nth).where("_nth = 1").drop("_nth", "batch")
