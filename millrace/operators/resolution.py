"""Sources: which of the configured ones run, and which are due by their cadence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import trimmed


def resolved(config: DataFrame, registry: DataFrame) -> DataFrame:
    """config (source_id, active, access_method, credentials: array) against registry (source_id, access_method,
    required: array): status and detail of each configured source."""
    r = registry.select("source_id", F.col("access_method").alias("_method"), "required").withColumn("_known", F.lit(True))
    rows = config.join(r, "source_id", "left")
    missing = F.size(F.array_except(F.coalesce("required", F.array().cast("array<string>")), F.coalesce("credentials", F.array().cast("array<string>"))))
    status = (
        F.when(~F.col("active"), F.struct(F.lit("skipped"), F.lit("inactive")))
        .when(F.col("_known").isNull(), F.struct(F.lit("config_error"), F.lit("unknown source")))
        .when(F.col("access_method") != F.col("_method"), F.struct(F.lit("config_error"), F.lit("access method mismatch")))
        .when(missing > 0, F.struct(F.lit("config_error"), F.lit("missing credentials")))
        .otherwise(F.struct(F.lit("ready"), F.lit("")))
    )
    return rows.select(*config.columns, status["col1"].alias("status"), status["col2"].alias("detail"))


def bad_overlay(overlay: DataFrame, catalog: DataFrame) -> DataFrame:
    """Overlay rows that make an activation fatal: unknown, repeated, of another access method, with credentials."""
    known = catalog.select("source_id", F.col("access_method").alias("_method"))
    repeated = overlay.groupBy("source_id").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    rows = overlay.join(repeated, "source_id").join(known, "source_id", "left")
    why = F.when(F.col("_method").isNull(), "unknown").when(F.col("repeated"), "duplicate").when(F.col("access_method") != F.col("_method"), "mismatch").when(F.size("credentials") > 0, "credentials")
    return rows.select("source_id", why.alias("problem")).where("problem IS NOT NULL").distinct()


def bad_catalog(catalog: DataFrame) -> DataFrame:
    """Catalog rows that make it invalid as a whole: no id or name, a repeated id, an access method that is not known,
    a feed that is not https, a cadence that is not positive."""
    repeated = catalog.groupBy("source_id").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    rows = catalog.join(repeated, "source_id", "left")
    why = (
        F.when(F.coalesce(trimmed("source_id"), F.lit("")) == "", "id")
        .when(F.coalesce(trimmed("display_name"), F.lit("")) == "", "name")
        .when(F.col("repeated"), "duplicate")
        .when(~F.col("access_method").isin("rss", "atom", "api", "sample"), "access_method")
        .when(~F.coalesce(F.col("url"), F.lit("")).startswith("https://"), "url")
        .when(F.coalesce("cadence_nano", F.lit(0)) <= 0, "cadence")
    )
    return rows.select("source_id", why.alias("problem")).where("problem IS NOT NULL").distinct()


def cadence_due(config: DataFrame, health: DataFrame, now_nano: int) -> DataFrame:
    """config (source_id, cadence_nano, null: no guard) with due: the last attempt is at least a cadence ago."""
    rows = config.join(health.select("source_id", "last_attempt_nano"), "source_id", "left")
    due = F.col("cadence_nano").isNull() | F.col("last_attempt_nano").isNull() | (F.lit(now_nano) >= F.col("last_attempt_nano") + F.col("cadence_nano"))
    return rows.withColumn("due", due)
