"""Identities of signals, stable identifiers, funding payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import alias_eligible, bound, name_token, plain_token, trimmed, without_suffix
from millrace.functions.times import rfc3339
from millrace.functions.urls import normal_url

FUNDING = "struct<round:string,amount:string,currency:string,investors:array<string>>"
PAYLOAD = "categories array<string>, funding struct<Round:string,Amount:string,Currency:string,Investors:array<string>>"
PAYLOAD_LOWER = f"categories array<string>, funding {FUNDING}"


def payload(raw: Column) -> Column:
    """struct(categories, funding) of a JSON payload whose funding keys are capitalised or not; one that is missing, not
    JSON or has a field of another type is empty as a whole."""
    spark_ok = F.try_parse_json(raw)
    upper, lower = F.from_json(raw, PAYLOAD), F.from_json(raw, PAYLOAD_LOWER)
    none = F.array().cast("array<string>")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(spark_ok, path, "variant"))
    wrong = F.lit(False)
    for path, fine in (("$.categories", "ARRAY<"), ("$.funding", "OBJECT<"), ("$.funding.Round", "STRING"), ("$.funding.Amount", "STRING"), ("$.funding.Currency", "STRING"), ("$.funding.round", "STRING"), ("$.funding.amount", "STRING"), ("$.funding.currency", "STRING")):
        wrong = wrong | ~F.coalesce(kind(path).startswith(fine) | kind(path).startswith("VOID"), F.lit(True))
    fine = F.coalesce(raw, F.lit("")).rlike(r"^\s*\{") & spark_ok.isNotNull() & ~wrong
    pick = lambda u, lo: F.when(fine, F.coalesce(upper["funding"][u], lower["funding"][lo]))
    funding = F.struct(
        F.coalesce(pick("Round", "round"), F.lit("")).alias("round"),
        F.coalesce(pick("Amount", "amount"), F.lit("")).alias("amount"),
        F.coalesce(pick("Currency", "currency"), F.lit("")).alias("currency"),
        F.coalesce(pick("Investors", "investors"), none).alias("investors"),
    )
    return F.struct(F.coalesce(F.when(fine, upper["categories"]), none).alias("categories"), funding.alias("funding"))


def to_payload(categories: Column, funding: Column) -> Column:
    return F.to_json(F.struct(categories.alias("categories"), F.struct(funding["round"].alias("Round"), funding["amount"].alias("Amount"), funding["currency"].alias("Currency"), funding["investors"].alias("Investors")).alias("funding")))


def fingerprint(funding: Column) -> Column:
    """Amount and currency as one token; empty unless both are known."""
    amount, currency = plain_token(funding["amount"]), F.upper(trimmed(funding["currency"]))
    return F.when((amount != "") & (currency != ""), F.concat_ws(":", amount, currency)).otherwise("")


def identity(name: Column, region: Column, scope: Column, canonical: Column, source_url: Column, funding: Column) -> Column:
    """struct(url, exact, suffix, event, funding): keys under which signals may be the same, empty where there is none.
    Names count only within a region and scope (the digest's day)."""
    key = lambda kind, token, of: F.concat_ws(":", F.lit(kind), token, of["where"], of["day"])

    def keys(of: Column) -> Column:
        return bound(
            without_suffix(of["exact"]),
            lambda suffix: F.struct(
                F.when(alias_eligible(of["exact"]), key("exact", of["exact"], of)).otherwise("").alias("exact"),
                F.when((suffix != of["exact"]) & alias_eligible(suffix), key("suffix", suffix, of)).otherwise("").alias("suffix"),
            ),
        )

    names = bound(F.struct(name_token(name).alias("exact"), name_token(region).alias("where"), plain_token(scope).alias("day")), keys)
    return F.struct(
        F.coalesce(F.concat(F.lit("url:"), normal_url(canonical)), F.lit("")).alias("url"),
        names["exact"].alias("exact"),
        names["suffix"].alias("suffix"),
        F.coalesce(normal_url(source_url), F.lit("")).alias("event"),
        fingerprint(funding).alias("funding"),
    )


def short_hash(prefix: str, digest: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, 24))


def signal_id(source: Column, canonical: Column, source_url: Column, name: Column, nano: Column) -> Column:
    """Depends on what identifies a signal alone, so a replayed feed gives the same rows."""
    return short_hash("sig", F.sha1(F.concat_ws("|", source, F.coalesce(canonical, F.lit("")), F.coalesce(source_url, F.lit("")), name_token(name), rfc3339(nano)).cast("binary")))


def digest_id(subscriber: Column, date: Column) -> Column:
    return short_hash("dig", F.sha2(F.concat_ws(":", subscriber.cast("string"), date), 256))


def item_id(digest: Column, rank: Column) -> Column:
    return short_hash("item", F.sha2(F.concat_ws(":", digest, rank.cast("string")), 256))


def delivery_id(subscriber: Column, date: Column) -> Column:
    return short_hash("del", F.sha1(F.concat_ws(":", subscriber.cast("string"), date).cast("binary")))


def attempt_id(delivery: Column, nano: Column, status: Column, sequence: Column, message: Column, code: Column, error: Column) -> Column:
    """Hash of the whole report, so that an identical replay is known; a report without sequence has the older form."""
    fields = lambda with_sequence: F.struct(
        delivery.alias("delivery_id"), rfc3339(nano).alias("attempted_at"), status.alias("status"), *([sequence.alias("sequence")] if with_sequence else []),
        message.alias("telegram_message_id"), code.alias("error_code"), error.alias("error_message"),
    )
    text = F.when(sequence.isNull(), F.to_json(fields(False))).otherwise(F.to_json(fields(True)))
    for plain, code_ in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(plain), F.lit(code_))
    return F.concat(F.lit("attempt-"), F.sha2(text, 256))
