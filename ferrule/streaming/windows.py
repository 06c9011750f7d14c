"""Event-time operators for Structured Streaming; each also runs on a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ferrule.operators.tables import carried

LATE = "10 minutes"


def windowed_stats(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Count, sum and mean of value by type and window, with a watermark."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", LATE).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_arrivals(events: DataFrame, key: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key])


def admit(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Sliding-window limiter for each user: a request is admitted if fewer than `limit` were admitted in the `seconds` before it. State is what the window holds, on a batch too."""

    def step(held: tuple, row: tuple) -> tuple[tuple, bool]:
        _, at, _ = row
        held = tuple(x for x in held if x > at - seconds)
        free = len(held) < limit
        return (held + (at,) if free else held), free

    def stream(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, told = tuple(state.get[0]) if state.exists else (), []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])  # a user's rows of one micro-batch
        for row in rows.itertuples(index=False):
            held, free = step(held, row)
            told.append(free)
        state.update((list(held),))
        yield rows[["user_id", "event_id"]].assign(admitted=told)

    keyed = events.select("user_id", F.col("ts").cast("double").alias("at"), "event_id")
    if not events.isStreaming:
        return carried(keyed, ["at", "event_id"], (), step, "admitted").select("user_id", "event_id", "admitted")
    return keyed.groupBy("user_id").applyInPandasWithState(stream, "user_id long, event_id long, admitted boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def spend(events: DataFrame, each: int, cap: int) -> DataFrame:
    """Token bucket for each user (user_id, at in microseconds, event_id): a token comes every `each` microseconds, `cap` fit in; a request takes one or is refused. Whole numbers throughout."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, bool]:
        _, at, _ = row
        held = cap * each if state is None else min(cap * each, state[0] + at - state[1])
        taken = held >= each
        return (held - each * taken, at), taken

    return carried(events.select("user_id", "at", "event_id"), ["at", "event_id"], None, step, "admitted")


def limit_requests(events: DataFrame, limit: int, span: int, each: int, cap: int) -> DataFrame:
    """Both limits in turn: fewer than `limit` requests admitted in the `span` microseconds before, then a token, which only such requests take."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, bool]:
        _, at, _ = row
        past, held, last = state or ((), cap * each, at)
        past, held = tuple(x for x in past if x > at - span), min(cap * each, held + at - last)
        free = len(past) < limit
        taken = free and held >= each
        return (past + (at,) if free else past, held - each * taken, at), taken

    return carried(events.select("user_id", "at", "event_id"), ["at", "event_id"], None, step, "admitted")
