"""Scheduled passes: every firing of a cron expression adds work."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cron import firings
from .config import create_collector_requests
from .frontier import collectors, periodic, row_id


def expand_cron(uri: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """``uri`` rows with fires_at for each firing of their ``cron`` in [start, end)."""
    return uri.join(firings(uri, "cron", start, end), "cron")


def periodic_pass(uri: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """A work item (id, uri_id, due_at) for each firing of a periodic row."""
    fired = expand_cron(periodic(uri), start, end)
    return fired.select(row_id("id", "fires_at").alias("id"), F.col("id").alias("uri_id"), F.col("fires_at").alias("due_at"))


def collector_pass(uri: DataFrame, config: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """A collector request for each firing of a collector row."""
    fired = expand_cron(collectors(uri), start, end).select("id", "uri", "fires_at")
    return create_collector_requests(fired, config)
