"""Structured Streaming forms of the frontier, the exchange and the counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.urls import host
from ..operators.exchange import Exchange, envelope
from ..operators.frontier import ingest_uris, row_id
from ..sources.batches import BatchTable, StateTable


def _start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stream_ingest(events: DataFrame, frontier: Callable[[], DataFrame], responses: Callable[[], DataFrame], config: DataFrame, append: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Ingest crawl events (event_id, base_uri, uri, uri_type, ts) batch by batch: ``append(rows, batch_id)`` gets the outcomes and stores the new rows.

    ``frontier`` and ``responses`` give the tables as they are when a batch begins. Without an interval what is there is taken once.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        out = ingest_uris(df, frontier(), responses(), config)
        append(out.withColumn("id", F.when(F.col("uri").isNotNull(), row_id("event_id", "uri"))), batch_id)

    return _start(events, batch, checkpoint, interval)


def ingest_into(events: DataFrame, table: BatchTable, responses: Callable[[], DataFrame], config: DataFrame, checkpoint: str, interval: str | None = None, within: str | None = None) -> StreamingQuery:
    """Ingest crawl events into ``table`` (the frontier's rows by batch) so that every event counts once, whatever runs again: a batch sees the rows of earlier batches
    only, and replaces its own. With ``within``, a uri and type that come again within that event time are left out before anything is joined."""
    spark = events.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        out = ingest_uris(df, table.before(spark, batch_id), responses(), config)
        table.put(out.where("uri is not null").withColumn("id", row_id("event_id", "uri")), batch_id)

    return _start(first_seen(events, within) if within else events, batch, checkpoint, interval)


def first_seen(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events (uri, uri_type, ts) without those whose lower-case uri and type were seen within the watermark."""
    return events.withWatermark("ts", delay).withColumn("_key", F.lower("uri")).dropDuplicatesWithinWatermark(["_key", "uri_type"]).drop("_key")


def stream_exchange(messages: DataFrame, exchange: Exchange, deadletter: Callable[..., None], checkpoint: str, interval: str | None = None, state: StateTable | None = None, by_batch: bool = False) -> StreamingQuery:
    """Run an exchange on a stream of messages: every batch is routed, transformed and published; failures go to ``deadletter`` (with the batch's number if ``by_batch``).

    With ``state`` a batch's messages are stored before the work and cleared after it. What a stopped run has left is worked on first, under its own batch number and without
    being stored again; when Spark brings that batch back it is passed over."""
    spark = messages.sparkSession

    def work(df: DataFrame, batch_id: int) -> None:
        exchange.publish(exchange.run(df, whole=state is not None), deadletter, batch_id if by_batch else None)
        if state:
            state.clear(spark, batch_id)

    def batch(df: DataFrame, batch_id: int) -> None:
        if state is None:
            work(df, batch_id)
        elif not state.is_done(spark, batch_id):
            work(state.store(envelope(df), batch_id), batch_id)

    for left in state.outstanding(spark) if state else []:
        work(state.rows(spark, left), left)
    return _start(messages, batch, checkpoint, interval)


def live_counters(messages: DataFrame, every: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """(start, stage, payload_type, n) per window of event time ``ts``."""
    counted = messages.withWatermark("ts", delay).groupBy(F.window("ts", every), "stage", "payload_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "stage", "payload_type", "n")


def active_hosts(requests: DataFrame, ttl_seconds: int = 15, delay: str = "0 seconds") -> DataFrame:
    """(host, last_at, n, state) from a stream of requests (uri, at): a row whenever a host is seen (``active``), and one when it has been silent for the time to live (``expired``).

    The state of a host is dropped at its time-out in event time, so that it doesn't grow with all hosts ever seen.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({"host": [key[0]], "last_at": [datetime.fromtimestamp(last / 1000)], "n": [n], "state": ["expired"]})
            return
        last, n = state.get if state.exists else (0, 0)
        for part in rows:
            n += len(part)
            last = max(last, int(part["at_ms"].max()))
        state.update((last, n))
        state.setTimeoutTimestamp(max(last + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"host": [key[0]], "last_at": [datetime.fromtimestamp(last / 1000)], "n": [n], "state": ["active"]})

    keyed = requests.withWatermark("at", delay).select(host("uri").alias("host"), "at", F.unix_millis("at").alias("at_ms"))
    return keyed.groupBy("host").applyInPandasWithState(step, "host string, last_at timestamp, n long, state string", "last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
