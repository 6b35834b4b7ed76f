"""Sending a delivery's messages in order, up to the first failure.

What a sender reports follows from the answers that it gets: one report for each message, as far as the first that fails,
and none beyond; a message without a sound sequence stops the delivery without a report. The first stop of a delivery is
a minimum, so a delivery with many messages is worked out by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is said of failures, instead of the service's own words.
REJECTED, UNAVAILABLE = "Telegram API rejected the delivery", "Telegram delivery is unavailable"


def reports(messages: DataFrame) -> DataFrame:
    """(delivery_id, at, attempted_nano, status, sequence, message_id, error_code, error_message) of messages (delivery_id, at:
    place in the delivery, sequence, attempted_nano, answer: ok, rejected, blocked or unavailable, message_id, error_code)."""
    sound = F.coalesce(F.col("sequence") > 0, F.lit(False))
    rows = messages.withColumn("_stops", ~sound | (F.col("answer") != "ok"))
    first = rows.groupBy("delivery_id").agg(F.min(F.when(F.col("_stops"), F.col("at"))).alias("_stop"))
    # deliveries that nothing stops need no join
    rows = rows.join(first.where("_stop IS NOT NULL"), "delivery_id", "left")
    rows = rows.where((F.col("_stop").isNull() | (F.col("at") <= F.col("_stop"))) & sound)
    ok, answered = F.col("answer") == "ok", F.col("answer").isin("rejected", "blocked")
    return rows.select(
        "delivery_id",
        "at",
        "attempted_nano",
        F.when(ok, "success").when(F.col("answer") == "blocked", "blocked").otherwise("failed").alias("status"),
        "sequence",
        F.when(ok, F.col("message_id")).alias("message_id"),
        F.when(answered, F.col("error_code")).alias("error_code"),
        F.when(answered, REJECTED).when(~ok, UNAVAILABLE).alias("error_message"),
    )


def sent(reports_: DataFrame) -> DataFrame:
    """(delivery_id, sent): the messages that each delivery got off; deliveries that could send nothing at all are not in it."""
    return reports_.groupBy("delivery_id").agg(F.count(F.when(F.col("status") == "success", 1)).alias("sent"))
