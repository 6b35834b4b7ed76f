"""Health: state of sources and deliveries, and recent failures in general words only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEALTHY = ("ok", "skipped")
FAILING = ("retry", "failed", "blocked")


def clamp(limit: int) -> int:
    return 10 if limit <= 0 else min(limit, 100)


def failures(sources: DataFrame, deliveries: DataFrame, attempts: DataFrame, limit: int = 10) -> DataFrame:
    """(occurred_nano, component, message): newest first, at most `limit`. A delivery's failure is as late as its latest
    report."""
    source = sources.where(~F.col("status").isin(*HEALTHY)).select(F.col("last_ingestion_nano").alias("occurred_nano"), F.concat(F.lit("source:"), "source_id").alias("component"), F.lit("source is unhealthy").alias("message"))
    last = attempts.groupBy(F.col("delivery_id").alias("id")).agg(F.max("attempted_nano").alias("last_nano"))
    said = F.when(F.col("status") == "retry", "delivery is awaiting retry").when(F.col("status") == "blocked", "delivery was blocked").otherwise("delivery permanently failed")
    failed = deliveries.where(F.col("status").isin(*FAILING)).join(last, "id", "left")
    failed = failed.select(F.greatest("created_nano", "last_nano").alias("occurred_nano"), F.concat(F.lit("delivery:"), F.col("id").cast("string")).alias("component"), said.alias("message"))
    return source.unionByName(failed).orderBy(F.col("occurred_nano").desc(), "component").limit(clamp(limit))


def summary(sources: DataFrame, subscribers: DataFrame, deliveries: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row: last_ingestion_nano, active_subscribers, last_activity_nano, degraded."""
    s = sources.agg(F.max("last_ingestion_nano").alias("last_ingestion_nano"), F.max(~F.col("status").isin(*HEALTHY)).alias("bad_source"))
    a = subscribers.agg(F.count(F.when(F.col("active"), 1)).alias("active_subscribers"))
    activity = deliveries.select(F.col("created_nano").alias("at")).unionByName(attempts.select(F.col("attempted_nano").alias("at"))).agg(F.max("at").alias("last_activity_nano"))
    d = deliveries.agg(F.max(F.col("status").isin(*FAILING)).alias("bad_delivery"))
    one = s.crossJoin(a).crossJoin(activity).crossJoin(d)  # one row each
    degraded = F.coalesce("bad_source", F.lit(False)) | F.coalesce("bad_delivery", F.lit(False))
    return one.select("last_ingestion_nano", "active_subscribers", "last_activity_nano", degraded.alias("degraded"))
