"""Counters: funnels, outcomes, durations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("incoming", "transformed", "published", "error")


def funnel(messages: DataFrame) -> DataFrame:
    """One row per payload_type with the number of messages in each stage."""
    wide = messages.groupBy("payload_type").pivot("stage", list(STAGES)).agg(F.count(F.lit(1)))
    return wide.select("payload_type", *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in STAGES])


def stage_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("stage", "payload_type").agg(F.count("*").alias("n"))


def crawl_outcomes(events: DataFrame, outcomes: tuple[str, ...] = ("started", "completed", "failed")) -> DataFrame:
    """One row per host with the number of crawls of each outcome."""
    wide = events.groupBy("host").pivot("outcome", list(outcomes)).agg(F.count(F.lit(1)))
    return wide.select("host", *[F.coalesce(o, F.lit(0)).cast("long").alias(o) for o in outcomes])


def mean_duration(spans: DataFrame) -> DataFrame:
    """(job, n, mean_s) from rows of job, started_at, ended_at; open spans don't count."""
    seconds = F.col("ended_at").cast("double") - F.col("started_at").cast("double")
    return spans.where("started_at is not null and ended_at is not null").groupBy("job").agg(F.count("*").alias("n"), (F.sum(seconds) / F.count("*")).alias("mean_s"))
