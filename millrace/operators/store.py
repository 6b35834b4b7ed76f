"""Keyed tables on Parquet: upserts that can be repeated, additive schema changes, replacement of whole parts.

A keyed table is replaced by the union of the new rows and the old rows without a new one. Where a batch has several new
rows of a key, they count in their order, as if they had been saved one after the other: they are reduced to the one row
that this comes to first, by minima and maxima that tasks work out before anything moves. Tables that change together
are written as one version (see versions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import versions


def in_order(rows: DataFrame, order: list[str]) -> Column:
    """A row's place: by `order`, then by all that it says, so that equal rows alone are at one place."""
    return F.struct(*order, *[F.col(c).cast("string") for c in rows.columns if c not in order])


def last_by(rows: DataFrame, keys: list[str], order: list[str], **others: Column) -> DataFrame:
    """One row per key, the last in order. others gives aggregates for columns that are not the last row's; `_place` is a row's
    place."""
    rest = [c for c in rows.columns if c not in keys]
    placed = rows.withColumn("_place", in_order(rows, order))
    whole = placed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_place").alias("_r"), *[v.alias(f"_{c}") for c, v in others.items()])
    return whole.select(*keys, *[F.col(f"_{c}" if c in others else f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def last_known(column: str, known: Column) -> Column:
    """Of a key's rows the last value that is known."""
    return F.max_by(F.when(known, F.col(column)), F.when(known, F.col("_place")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], merge: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """old with the rows of new put in. merge gives columns of a row that is in both, in terms of old.x and new.x; when
    says whether the old row may be changed at all."""
    o, n = old.alias("old"), new.alias("new")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"old.{k}") == F.col(f"new.{k}"))
    rows = o.join(n, same, "full_outer")
    is_new, is_old = F.col(f"new.{keys[0]}").isNotNull(), F.col(f"old.{keys[0]}").isNotNull()
    change = is_new if when is None else is_new & (~is_old | when)

    def value(c: str) -> Column:
        both = (merge or {}).get(c, F.col(f"new.{c}") if c in new.columns else F.col(f"old.{c}"))
        fresh = F.col(f"new.{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
        return F.when(~change, F.col(f"old.{c}")).when(is_old, both).otherwise(fresh).alias(c)

    return rows.select(*[value(c) for c in old.columns])


def save_subscribers(old: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """created_nano is the first, and a username stays unless a new one is not empty."""
    one = last_by(new, ["telegram_id"], [*order], username=F.coalesce(last_known("username", F.col("username") != ""), F.lit("")), created_nano=F.min_by("created_nano", "_place"))
    return upsert(old, one, ["telegram_id"], {"created_nano": F.col("old.created_nano"), "username": F.coalesce(F.nullif(F.col("new.username"), F.lit("")), F.col("old.username"))})


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first new row of each key that is not there."""
    rest = [c for c in new.columns if c not in keys]
    one = new.withColumn("_place", in_order(new, [*order])).groupBy(*keys).agg(F.min_by(F.struct(*rest), "_place").alias("_r")).select(*keys, "_r.*")
    return old.unionByName(one.join(old, keys, "left_anti").select(*old.columns))


def save_subscriptions(subscriptions: DataFrame, settings: DataFrame, new: DataFrame, defaults: dict, *order: str) -> tuple[DataFrame, DataFrame]:
    """(subscriptions, preferences) after new subscriptions (telegram_id, source_id, ...): each pair once, and the default
    preferences for subscribers that have none."""
    given = {c: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v) for c, v in defaults.items()}
    people = new.select("telegram_id").distinct().select("telegram_id", *[v.alias(c) for c, v in given.items()])
    return insert_absent(subscriptions, new, ["telegram_id", "source_id"], *order), insert_absent(settings, people.select(*settings.columns), ["telegram_id"])


def save_health(old: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """An empty last attempt keeps the one before."""
    one = last_by(new, ["source_id"], [*order], last_attempt_nano=last_known("last_attempt_nano", F.col("last_attempt_nano").isNotNull()))
    return upsert(old, one, ["source_id"], {"last_attempt_nano": F.coalesce("new.last_attempt_nano", "old.last_attempt_nano")})


def save_signals(old: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    return upsert(old, last_by(new, ["id"], [*order]), ["id"])


def save_deliveries(old: DataFrame, new: DataFrame, terminal: tuple[str, ...], *order: str) -> DataFrame:
    """Terminal deliveries stay, also one that a new row made terminal; cursor and creation are the first."""
    place = in_order(new, [*order])
    ended = F.col("status").isin(*terminal)
    rest = [c for c in new.columns if c != "id"]
    rows = new.withColumns({"_place": place, "_ended": ended})
    whole = rows.groupBy("id").agg(F.min_by(F.struct(*rest), "_place").alias("_first"), F.min_by(F.when(F.col("_ended"), F.struct(*rest)), F.when(F.col("_ended"), F.col("_place"))).alias("_end"), F.max_by(F.struct(*rest), "_place").alias("_last"))
    kept = ("confirmed_through", "created_nano")
    one = whole.withColumn("_r", F.coalesce("_end", "_last")).select("id", *[F.col(f"{'_first' if c in kept else '_r'}.{c}").alias(c) for c in rest])
    return upsert(old, one, ["id"], {c: F.col(f"old.{c}") for c in kept}, when=~F.col("old.status").isin(*terminal))


def migrated(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """rows with the columns they lack, at their defaults."""
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})


def save_snapshots(old: DataFrame, runs: DataFrame, items: DataFrame, key: str = "digest_id") -> DataFrame:
    """The items of all digests after these runs were saved anew: a run's old items go, those given for it come, also where
    there are none. Items of no given run, and repeated runs, change nothing. Write it with swap(): readers see all of it
    or none."""
    saved = runs.select(key).distinct()
    return old.join(saved, key, "left_anti").unionByName(items.join(saved, key, "left_semi").select(*old.columns))


def refused_ingestions(new_signals: DataFrame, new_health: DataFrame) -> DataFrame:
    """(ingestion) of the ingestions that have a signal of another source than the one whose health they report."""
    own = new_health.select("ingestion", F.col("source_id").alias("_source")).distinct()
    return new_signals.join(own, "ingestion", "left").where(F.col("_source").isNull() | (F.col("_source") != F.col("source_id"))).select("ingestion").distinct()


def save_ingestions(spark: SparkSession, base: str, schemas: dict[str, StructType], new_signals: DataFrame, new_health: DataFrame, *order: str) -> DataFrame:
    """Saves ingestions, each one source's signals and health under one `ingestion`, into the tables signals and health of the
    versions at base, as one version: readers see both or neither. An ingestion with a foreign signal is refused as a
    whole, and its number returned."""
    refused = refused_ingestions(new_signals, new_health)
    before = versions.current(spark, base)
    old = {t: versions.read(spark, base, t, schemas[t], before) for t in ("signals", "health")}
    sound = lambda rows, names: rows.join(refused, "ingestion", "left_anti").select(*dict.fromkeys([*names, *order]))
    signals = save_signals(old["signals"], sound(new_signals, old["signals"].columns), *order)
    health = save_health(old["health"], sound(new_health, old["health"].columns), *order)
    versions.commit(spark, base, {"signals": signals.select(*schemas["signals"].names), "health": health.select(*schemas["health"].names)}, before=before)
    return refused


def attempt_times(health: DataFrame) -> DataFrame:
    """Sources that were tried, but whose last attempt is not stored, take the time of the last ingestion for it."""
    tried = F.col("last_attempt_nano").isNull() & F.col("status").isin("ok", "failed", "fetching")
    return health.withColumn("last_attempt_nano", F.when(tried, F.col("last_ingestion_nano")).otherwise(F.col("last_attempt_nano")))


def read_versions(spark: SparkSession, paths: dict[int, str], schemas: dict[int, StructType], defaults: dict[str, Column]) -> DataFrame:
    """One table of folders whose files have different versions of a schema: columns that a version lacks have their default,
    those that it has keep their nulls. The last version's schema is that of the result."""
    last = schemas[max(schemas)]
    out = None
    for version, path in sorted(paths.items()):
        rows = spark.read.schema(schemas[version]).parquet(path)
        rows = migrated(rows, defaults).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in last])
        out = rows if out is None else out.unionByName(rows)
    return out
