"""The quality gate of normalisation: records that pass become signals, others get their first failing reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import identity as ids
from millrace.functions.text import squeezed, trimmed, valid_name
from millrace.functions.urls import normal_url

# Fixed values.
TYPES = ("acquisition", "award", "funding", "launch", "news", "ranking")
REASONS = ("missing_source_id", "missing_startup_name", "invalid_startup_name", "missing_source_url", "invalid_source_url", "missing_published_at", "future", "stale", "invalid_canonical_url", "invalid_signal_type")


def fresh(nano: Column, now_nano: int, max_age: int | None, max_skew: int | None) -> Column:
    """`future`, `stale` or null; both bounds are inclusive."""
    out = F.lit(None).cast("string")
    if max_age:
        out = F.when(nano < now_nano - max_age, "stale").otherwise(out)
    if max_skew:
        out = F.when(nano > now_nano + max_skew, "future").otherwise(out)
    return out


def gated(records: DataFrame, now_nano: int, max_age: int | None, max_skew: int | None) -> DataFrame:
    """records (source_id, startup_name, source_url, canonical_url, signal_type, published_nano, description, region,
    categories, funding, raw_payload) with trimmed values, id, raw_payload and reason (null: passed)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    r = records.withColumns({"source_id": trimmed(text("source_id")), "startup_name": squeezed(text("startup_name")), "source_url": trimmed(text("source_url")), "canonical_url": trimmed(text("canonical_url")), "signal_type": F.lower(trimmed(text("signal_type"))), "description": trimmed(text("description")), "region": trimmed(text("region"))})
    r = r.withColumn("signal_type", F.when(F.col("signal_type") == "", "news").otherwise(F.col("signal_type")))
    r = r.withColumns({"_url": normal_url(F.col("source_url")), "_canonical": F.when(F.col("canonical_url") != "", normal_url(F.col("canonical_url")))})
    late = fresh(F.col("published_nano"), now_nano, max_age, max_skew)
    tests = (
        F.col("source_id") == "",
        F.col("startup_name") == "",
        ~valid_name(F.col("startup_name")),
        F.col("source_url") == "",
        F.col("_url").isNull(),
        F.col("published_nano").isNull(),
        F.coalesce(late == "future", F.lit(False)),
        F.coalesce(late == "stale", F.lit(False)),
        (F.col("canonical_url") != "") & F.col("_canonical").isNull(),
        ~F.col("signal_type").isin(*TYPES),
    )
    reason = F.coalesce(*[F.when(t, name) for t, name in zip(tests, REASONS, strict=True)])
    payload = F.when(text("raw_payload") != "", F.col("raw_payload")).otherwise(ids.to_payload(F.col("categories"), F.col("funding")))
    key = ids.signal_id(F.col("source_id"), F.col("_canonical"), F.col("_url"), F.col("startup_name"), F.col("published_nano"))
    r = r.withColumns({"reason": reason, "raw_payload": payload, "canonical_url": F.coalesce("_canonical", F.lit(""))})
    return r.withColumn("id", F.when(F.col("reason").isNull(), key)).drop("_url", "_canonical")


def passed(gated_: DataFrame) -> DataFrame:
    return gated_.where("reason IS NULL").drop("reason")


def accounting(gated_: DataFrame, adapter_skipped: DataFrame | None = None) -> DataFrame:
    """Per source: fetched = normalized + skipped, skipped = adapter_skipped + rejected, counts by reason, and the status:
    a source that yields nothing of what it fetched is `zero_yield`."""
    by_reason = gated_.groupBy("source_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    out = by_reason.groupBy("source_id").agg(
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("normalized"),
        F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("rejected"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws("=", "reason", F.col("n").cast("string"))))), ",").alias("reasons"),
    )
    if adapter_skipped is not None:
        out = out.join(adapter_skipped, "source_id", "left")
    skipped = F.coalesce(F.col("adapter_skipped"), F.lit(0)) if adapter_skipped is not None else F.lit(0)
    out = out.withColumn("adapter_skipped", skipped.cast("long"))
    out = out.withColumns({"skipped": F.col("adapter_skipped") + F.col("rejected"), "fetched": F.col("normalized") + F.col("adapter_skipped") + F.col("rejected")})
    return out.withColumn("status", F.when((F.col("fetched") > 0) & (F.col("normalized") == 0), "zero_yield").otherwise("ok"))


def rollup(statuses: DataFrame) -> DataFrame:
    """degraded where any source failed, is misconfigured or yields nothing."""
    bad = F.max(F.col("status").isin("failed", "config_error", "zero_yield"))
    return statuses.agg(F.when(F.coalesce(bad, F.lit(False)), "degraded").otherwise("ok").alias("status"), F.count(F.lit(1)).alias("sources"))
