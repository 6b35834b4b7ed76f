"""What must hold of a delivery that was sent: its stored digest, the messages that were rendered, and what was acknowledged.

Each rule is a fact of one delivery, made of counts, minima and maxima over its rows, so no delivery's rows are ever
together; and each broken rule is a row of its own, where a check that stops at the first would show one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import trimmed, unescaped
from millrace.functions.urls import public_url
from millrace.session import staged

MOST = 10
#: Conditions of sources under which a digest counts.
ACCESSIBLE = ("ok", "skipped", "zero_yield")
# What a digest with items says of its sources, and one without says instead.
SOURCES, NOTHING = "Источники:", "Подходящих стартапов"


def attributed(items: DataFrame) -> DataFrame:
    """items with the kind of fault of each attribution in attributions_json, and its URL where it is sound: one row for each,
    and one for a list that is none."""
    parsed = F.try_parse_json("attributions_json")
    is_list = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY<"), F.lit(False))
    listed = F.when(is_list, F.try_variant_get(parsed, "$", "array<variant>"))
    rows = items.withColumns({"_broken": parsed.isNull(), "_list": listed}).withColumn("_a", F.explode_outer("_list"))
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("_a", path, "variant")) == "STRING", F.try_variant_get("_a", path, "string"))
    rows = rows.withColumns({"_id": text("$.source_id"), "_url": text("$.source_url")}).withColumn("_public", F.coalesce(public_url(F.col("_url")), F.lit(False)))
    fault = (
        F.when(F.col("_broken"), "attribution_invalid")
        .when(F.col("_list").isNull() | (F.size("_list") == 0), "attribution_missing")
        .when(F.coalesce(trimmed(F.col("_id")), F.lit("")) == "", "attribution_invalid")
        .when(~F.col("_public"), "publisher_link_invalid")
    )
    return rows.withColumn("fault", fault).select(*items.columns, "fault", F.when(F.col("fault").isNull(), F.col("_url")).alias("url"))


def plain_text(text: Column) -> Column:
    """What a reader of a message sees."""
    return unescaped(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " "))


def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, kind) of the rules that hold for a row."""
    kinds = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), kind) for kind, rule in rules.items()]), lambda k: k.isNotNull())
    return rows.select(key, F.explode(kinds).alias("kind"))


def violations(deliveries: DataFrame, runs: DataFrame, items: DataFrame, messages: DataFrame, attempts: DataFrame, health: DataFrame) -> DataFrame:
    """(delivery_id, kind), one row for each rule that a delivery breaks.

    deliveries (delivery_id, digest_id, attempt, confirmed_through), runs (digest_id, candidate_count), items (digest_id, rank,
    candidate_identity, startup_name, attributions_json), messages (delivery_id, at: place from 0, sequence, text,
    parse_as), attempts (delivery_id, status, message_id), health (source_id, status). Whether texts name the items is asked
    only of digests within the limit of items. Nulls break the rule that they are asked for.
    """
    blank = lambda c: F.coalesce(trimmed(F.col(c)), F.lit("")) == ""
    some = lambda condition: F.count(F.when(condition, 1))
    of_digest = deliveries.join(runs, "digest_id")  # a delivery without a run has no receipt
    own = of_digest.select("delivery_id", "digest_id")
    # different values are counted one kind at a time: two at once would move a row for each of either, and then their counts
    ranks = items.select("digest_id", "rank").repartition("digest_id").groupBy("digest_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.min(F.coalesce("rank", F.lit(0))).alias("first"),
        F.max(F.coalesce("rank", F.lit(0))).alias("last"),
        F.count_distinct("rank").alias("ranks"),
    )
    named = items.where("candidate_identity <> ''").select("digest_id", "candidate_identity").repartition("digest_id").groupBy("digest_id").agg(F.count_distinct("candidate_identity").alias("identities"))
    facts = ranks.join(named, "digest_id", "left")
    # what a reader sees of each message, and what each attribution says, are worked out once
    hrefs = F.regexp_extract_all("text", F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\""), 1)
    bad = F.col("sequence").isNull() | blank("text") | ~F.col("parse_as").eqNullSafe(F.lit("HTML"))
    messages = staged(messages.select("delivery_id", bad.alias("bad"), (~F.col("sequence").eqNullSafe(F.col("at") + 1)).alias("misplaced"), plain_text(F.col("text")).alias("plain"), hrefs.alias("hrefs")))
    told = messages.groupBy("delivery_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        some(F.col("bad")).alias("bad_messages"),
        some(F.col("misplaced")).alias("out_of_order"),
        F.max(F.col("plain").contains(SOURCES)).alias("with_sources"),
        F.max(F.col("plain").contains(NOTHING)).alias("says_nothing"),
    )
    acknowledged = attempts.where("status = 'success'").groupBy("delivery_id").agg(F.count(F.lit(1)).alias("n_acks"), some(blank("message_id")).alias("no_id"))
    rows = of_digest.join(facts, "digest_id", "left").join(told, "delivery_id", "left").join(acknowledged, "delivery_id", "left")
    rows = staged(rows.na.fill(0, ["n_items", "ranks", "identities", "n_messages", "bad_messages", "out_of_order", "n_acks", "no_id"]))
    n = F.col("n_items")
    found = broken(
        rows,
        "delivery_id",
        {
            "digest_item_limit_exceeded": n > MOST,
            "candidate_count_invalid": F.coalesce("candidate_count", F.lit(-1)) < 0,
            "digest_candidate_count_mismatch": n != F.least(F.coalesce("candidate_count", F.lit(-1)), F.lit(MOST)),
            "digest_rank_invalid": (n > 0) & ((F.col("ranks") != n) | (F.col("first") != 1) | (F.col("last") != n)),
            "digest_candidate_identities_not_unique": F.col("identities") != n,
            "rendered_messages_missing": F.col("n_messages") == 0,
            "rendered_message_invalid": F.col("bad_messages") > 0,
            "rendered_sequence_invalid": F.col("out_of_order") > 0,
            "rendered_attribution_missing": (n > 0) & (F.col("n_messages") > 0) & ~F.col("with_sources"),
            "rendered_empty_state_missing": (n == 0) & (F.col("n_messages") > 0) & ~F.col("says_nothing"),
            "telegram_ack_missing": (F.coalesce("attempt", F.lit(0)) < 1) | (F.coalesce("confirmed_through", F.lit(0)) != F.col("n_messages")) | (F.col("n_acks") != F.col("n_messages")) | (F.col("no_id") > 0),
        },
    )
    sources = staged(attributed(items.select("digest_id", "attributions_json")).select("digest_id", "fault", "url"))
    faults = sources.where("fault IS NOT NULL").select("digest_id", F.col("fault").alias("kind")).distinct().join(own, "digest_id").select("delivery_id", "kind")
    shown = messages.select("delivery_id", F.explode("hrefs").alias("href")).select("delivery_id", unescaped(F.col("href")).alias("url")).distinct()
    rendered = rows.where("n_messages > 0").select("delivery_id", "digest_id")
    asked = sources.where("url IS NOT NULL").select("digest_id", "url").repartition("digest_id").distinct().join(rendered, "digest_id").select("delivery_id", "url")
    links = asked.join(shown, ["delivery_id", "url"], "left_anti").select("delivery_id", F.lit("rendered_publisher_link_missing").alias("kind")).distinct()
    few = rows.where((n <= MOST) & (F.col("n_messages") > 0)).select("delivery_id", "digest_id")
    names = few.join(items.select("digest_id", "startup_name"), "digest_id").join(messages.select("delivery_id", F.col("plain").alias("text")), "delivery_id")
    unnamed = names.groupBy("delivery_id", "startup_name").agg(F.max(F.col("text").contains(F.coalesce("startup_name", F.lit("")))).alias("named")).where("NOT named")
    out = found.unionByName(faults).unionByName(links).unionByName(unnamed.select("delivery_id", F.lit("rendered_item_missing").alias("kind")).distinct())
    of_sources = health.agg(F.count(F.lit(1)).alias("n"), some(blank("source_id") | ~F.coalesce(F.col("status").isin(*ACCESSIBLE), F.lit(False))).alias("bad"))
    troubles = broken(of_sources.withColumn("all", F.lit(1)), "all", {"source_health_missing": F.col("n") == 0, "source_access_unavailable": F.col("bad") > 0})
    # two kinds at most, for every delivery
    return out.unionByName(of_digest.select("delivery_id", F.lit(1).alias("all")).join(F.broadcast(troubles), "all").select("delivery_id", "kind"))
