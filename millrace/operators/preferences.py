"""Subscriber preferences: defaults, partial updates, validation, and the text form `key=value`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import bound, trimmed
from millrace.functions.scoring import stored_limit
from millrace.functions.times import valid_clock

LISTS = ("regions", "categories")
TEXTS = ("delivery_time", "timezone")
FIELDS = (*LISTS, *TEXTS, "max_items")


def with_defaults(prefs: DataFrame, defaults: dict) -> DataFrame:
    """Empty lists, empty texts and zero take the default."""
    put = {f: F.when(F.coalesce(F.size(f), F.lit(0)) == 0, F.array(*map(F.lit, defaults[f])).cast("array<string>")).otherwise(F.col(f)) for f in LISTS}
    put |= {f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit(defaults[f])) for f in TEXTS}
    return prefs.withColumns(put | {"max_items": F.when(F.coalesce("max_items", F.lit(0)) == 0, defaults["max_items"]).otherwise(F.col("max_items"))})


def patched(prefs: DataFrame, patches: DataFrame, key: str = "telegram_id") -> DataFrame:
    """A field takes the patch's value where that is there or where the patch says to replace it."""
    p = patches.select(key, "replace_fields", *[F.col(f).alias(f"_{f}") for f in FIELDS])
    rows = prefs.join(p, key, "left")

    def value(f: str) -> Column:
        given = F.col(f"_{f}").isNotNull() & ((F.size(f"_{f}") > 0) if f in LISTS else (F.col(f"_{f}") != "") if f in TEXTS else (F.col(f"_{f}") != 0))
        said = F.coalesce(F.array_contains("replace_fields", f), F.lit(False))
        empty = F.array().cast("array<string>") if f in LISTS else F.lit("") if f in TEXTS else F.lit(0)
        return F.when(F.coalesce(given, F.lit(False)) | said, F.coalesce(F.col(f"_{f}"), empty)).otherwise(F.col(f))

    return rows.select(*[F.col(c) if c not in FIELDS else value(c).alias(c) for c in prefs.columns])


def invalid(clock: Column, zone: Column, most: Column, zones: list[str]) -> Column:
    """The first field that is not valid, or null."""
    return F.when(~F.coalesce(valid_clock(clock), F.lit(False)), "delivery_time").when(~F.coalesce(zone.isin(*zones), F.lit(False)), "timezone").when(~F.coalesce(most.between(5, 10), F.lit(False)), "max_items")


def parsed(text: Column, zones: list[str]) -> Column:
    """struct of the fields of `regions=a,b time=09:00 timezone=UTC max=7`, and errors by key."""
    tokens = F.filter(F.split(trimmed(text), r"\s+"), lambda t: t != "")
    key = lambda t: F.lower(F.split_part(t, F.lit("="), F.lit(1)))
    value = lambda t: F.substring(t, F.locate("=", t) + 1, F.char_length(t))
    said = F.transform(tokens, lambda t: F.struct(t.contains("=").alias("sets"), key(t).alias("key"), value(t).alias("value")))
    known = ("regions", "categories", "time", "timezone", "max")
    of = lambda all_, name: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(all_, lambda t: t["sets"] & (t["key"] == name)), lambda t: t["value"])), -1)
    many = lambda v: F.when(v.isNotNull(), F.filter(F.transform(F.split(v, ","), lambda x: trimmed(x)), lambda x: x != ""))

    def fields(all_: Column, v: Column) -> Column:
        most = v["max"].try_cast("int")
        errors = F.array_compact(
            F.concat(
                F.transform(F.filter(all_, lambda t: ~t["sets"] | ~t["key"].isin(*known)), lambda t: F.concat(t["key"], F.lit(":unknown"))),
                F.array(F.when(v["time"].isNotNull() & ~valid_clock(v["time"]), "time:invalid"), F.when(v["timezone"].isNotNull() & ~v["timezone"].isin(*zones), "timezone:invalid"), F.when(v["max"].isNotNull() & ~F.coalesce(most.between(5, 10), F.lit(False)), "max:invalid")),
            )
        )
        return F.struct(many(v["regions"]).alias("regions"), many(v["categories"]).alias("categories"), v["time"].alias("delivery_time"), v["timezone"].alias("timezone"), most.alias("max_items"), errors.alias("errors"))

    return bound(said, lambda all_: bound(F.struct(*[of(all_, k).alias(k) for k in known]), lambda v: fields(all_, v)))


def stored(prefs: DataFrame) -> DataFrame:
    return prefs.withColumn("max_items", stored_limit(F.col("max_items")).cast("int"))


def contracts(subscribers: DataFrame, preferences: DataFrame) -> DataFrame:
    """(telegram_id, subscriber, preferences): what a service shows of a subscriber and of their preferences, as JSON. Lists
    that are null are shown empty; a subscriber without preferences has none to show."""
    none = F.array().cast("array<string>")
    settings = F.struct(F.coalesce("regions", none).alias("regions"), F.coalesce("categories", none).alias("categories"), "delivery_time", "timezone", "max_items")
    shown = preferences.select("telegram_id", F.to_json(settings).alias("preferences"))
    people = subscribers.select("telegram_id", F.to_json(F.struct("telegram_id", "username", "active")).alias("subscriber"))
    return people.join(shown, "telegram_id", "left")
