"""Queries that run a stream over the events table until it is drained; their SQL twins see what the watermark has passed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources.store import shared_path
from ferrule.streaming import machines


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a single file, a path only a folder


def _drained(out: DataFrame) -> DataFrame:
    at = shared_path(out.sparkSession, "stream")
    return machines.drain(out, f"{at}/rows", f"{at}/checkpoint")


def stm07_stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(machines.alerts(_events(spark, sf_dir).where("value is not null"), F.col("value") > 20, 7_200_000_000))


def stm09_stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(machines.timers(_events(spark, sf_dir).where("event_type in ('click', 'view')"), F.col("event_type") == "click"))


def src10_streamed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_path(spark, "upsert")
    rows = _events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value")
    machines.upsert_stream(rows, f"{at}/rows", f"{at}/checkpoint")
    return machines.current(spark, f"{at}/rows", ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stm07_stream_alerts": stm07_stream_alerts, "stm09_stream_timers": stm09_stream_timers, "src10_streamed_upsert": src10_streamed_upsert}
_PASSED = "epoch_us(ts) < 1000 * (SELECT epoch_ms(max(ts)) - 600000 FROM {})"
ORACLE_SQL: dict[str, str] = {
    "stm07_stream_alerts": f"""
        WITH e AS (SELECT * FROM events WHERE value IS NOT NULL), g AS (SELECT *, count(*) FILTER (value <= 20) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
        s AS (SELECT *, min(ts) FILTER (value > 20) OVER (PARTITION BY user_id, run) AS since FROM g)
        SELECT user_id, event_id, epoch_us(ts) - epoch_us(since) AS micros FROM s WHERE value > 20 AND epoch_us(ts) - epoch_us(since) >= 7200000000 AND {_PASSED.format("e")}""",
    "stm09_stream_timers": f"""
        WITH e AS (SELECT * FROM events WHERE event_type IN ('click', 'view')),
        n AS (SELECT user_id, event_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS till FROM e WHERE {_PASSED.format("e")})
        SELECT user_id, event_id, epoch_us(till) - epoch_us(ts) AS micros FROM n WHERE event_type = 'click' AND till IS NOT NULL""",
    "src10_streamed_upsert": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
}
