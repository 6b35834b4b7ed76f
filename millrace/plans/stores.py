"""Queries over stored tables, stored texts and the reading of digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import identity, text, times
from millrace.operators import backfill, delivery, preferences, receipts, render, resolution, store, versions, worker
from millrace.plans import derive
from millrace.plans.derive import NOW, NOW_NANO, START, with_
from millrace.session import staged
from millrace.streaming.deliveries import new_base

DEFAULTS = {"regions": ["EUROPE"], "categories": ["AI"], "delivery_time": "09:00", "timezone": "UTC", "max_items": 10}


def store_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subscribers come again: a new name is taken unless it is empty, the time of the first save stays."""
    s = derive.subscribers(spark, sf_dir).withColumn("created_nano", F.col("telegram_id") * F.lit(10**9))
    new = s.select("telegram_id", F.when(F.col("active"), F.upper("username")).otherwise("").alias("username"), (~F.col("active")).alias("active"), F.lit(NOW_NANO).alias("created_nano"))
    return store.save_subscribers(s, new)


def store_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions that orders stand for: finished orders first, then the others, each pair once."""
    o = derive.table(spark, sf_dir, "orders").select((F.col("o_custkey") + 1).alias("telegram_id"), F.col("o_orderpriority").alias("source_id"), F.col("o_orderstatus").alias("status"))
    pairs = lambda rows, origin: rows.select("telegram_id", "source_id", F.lit(origin).alias("origin")).distinct()
    return store.insert_absent(pairs(o.where("status = 'F'"), "old"), pairs(o.where("status <> 'F'"), "new"), ["telegram_id", "source_id"])


def store_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences with some fields empty take the defaults, and the limit that is stored."""
    p = derive.preferences(spark, sf_dir)
    k, none = F.col("telegram_id"), F.array().cast("array<string>")
    bare = p.withColumns({"regions": F.when(k % 3 == 0, none).otherwise(F.col("regions")), "timezone": F.when(k % 4 == 0, "").otherwise(F.col("timezone")), "delivery_time": F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("delivery_time"))})
    rows = preferences.stored(preferences.with_defaults(bare, DEFAULTS))
    return rows.select("telegram_id", F.array_join("regions", ",").alias("regions"), F.array_join("categories", ",").alias("categories"), "delivery_time", "timezone", "max_items")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as digests: their lines are the items, by line number."""
    li = derive.table(spark, sf_dir, "lineitem")
    part = derive.table(spark, sf_dir, "part")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("dig_"), F.col("l_orderkey").cast("string")).alias("digest_id"), F.col("l_linenumber").cast("int").alias("rank"), F.col("p_name").alias("startup_name"), F.col("l_quantity").cast("int").alias("quantity"))


def digest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of open orders are saved anew with the larger lines only, some of them with none."""
    runs = derive.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("dig_"), F.col("o_orderkey").cast("string")).alias("digest_id"))
    old = lines(spark, sf_dir)
    return store.save_snapshots(old, runs.union(runs), old.where("quantity > 40"))


def digest_of_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivery with its digest's items in order of rank, then name: what a reader of a stored delivery sees."""
    d = derive.deliveries(spark, sf_dir).select("id", "status", F.concat(F.lit("dig_"), F.substring_index("id", "_", -1)).alias("digest_id"))
    items = lines(spark, sf_dir).groupBy("digest_id").agg(F.array_sort(F.collect_list(F.struct("rank", "startup_name", "quantity"))).alias("items"))
    shown = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["rank"].cast("string"), i["startup_name"], i["quantity"].cast("string"))), ",")
    return d.join(items, "digest_id", "left").select("id", "status", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.coalesce(shown, F.lit("")).alias("items"))


def attempts_of_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts of each delivery in order of time, then id."""
    a = derive.attempts(spark, sf_dir)
    listed = F.array_sort(F.collect_list(F.struct("attempted_nano", "attempt_id", "status")))
    rows = a.groupBy("delivery_id").agg(listed.alias("a"))
    return rows.select("delivery_id", F.size("a").alias("n"), F.array_join(F.transform("a", lambda x: F.concat_ws("=", x["attempt_id"], x["status"])), ",").alias("attempts"))


SIGNAL = "source_id string, id string, startup_name string, published_nano bigint"
HEALTH = "source_id string, status string, last_ingestion_nano bigint, last_attempt_nano bigint"


def ingested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestions of the sources that were healthy, in versioned tables: signals and health change together, other sources
    stay, and an ingestion with a signal of another source changes nothing. A write that broke off leaves no trace."""
    h = derive.source_health(spark, sf_dir)
    s = h.select("source_id", F.concat(F.lit("sig_"), "source_id").alias("id"), F.lit("old").alias("startup_name"), F.col("last_ingestion_nano").alias("published_nano"))
    kinds = {"signals": spark.createDataFrame([], SIGNAL).schema, "health": spark.createDataFrame([], HEALTH).schema}
    base = new_base(spark, "store")
    versions.commit(spark, base, {"signals": s, "health": h.select(*kinds["health"].names)})
    number = F.substring_index("source_id", "#", -1).cast("long")
    healthy = h.where("status = 'ok'").withColumn("ingestion", number)
    new = s.join(healthy.select("source_id", "ingestion"), "source_id").withColumns({"startup_name": F.lit("new"), "published_nano": F.lit(NOW_NANO)})
    foreign = healthy.where("ingestion % 4 = 1").select(F.lit("elsewhere").alias("source_id"), F.lit("sig_elsewhere").alias("id"), F.lit("new").alias("startup_name"), F.lit(NOW_NANO).alias("published_nano"), "ingestion")
    store.save_ingestions(spark, base, kinds, new.unionByName(foreign), healthy.withColumn("last_ingestion_nano", F.lit(NOW_NANO)))
    s.withColumn("startup_name", F.lit("lost")).write.parquet(f"{base}/signals/of-a-commit-that-broke-off")
    at = versions.current(spark, base)
    signals, health = (versions.read(spark, base, t, kinds[t], at) for t in ("signals", "health"))
    return signals.join(health, "source_id").select("source_id", "startup_name", "published_nano", "status", "last_ingestion_nano")


def repeated_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an order saves its supplier's health, so a batch has the same source many times: the last save counts, and
    the last attempt that was known."""
    h = derive.source_health(spark, sf_dir)
    li = derive.table(spark, sf_dir, "lineitem")
    stamp = times.nanos(F.col("l_shipdate").cast("timestamp"))
    saves = li.select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("status"), stamp.alias("last_ingestion_nano"), F.when(F.col("l_partkey") % 3 == 0, stamp - 1).alias("last_attempt_nano"))
    names = derive.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("source_id"))
    new = saves.join(names, "k").drop("k")
    old = h.where("substring_index(source_id, '#', -1) % 3 <> 0")
    return store.save_health(old, new, "l_orderkey", "l_linenumber", "l_partkey").select("source_id", "status", "last_ingestion_nano", "last_attempt_nano")


def repeated_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order saves its customer as a subscriber: the first save's time and the last name that is not empty stay."""
    s = derive.subscribers(spark, sf_dir).where("telegram_id % 2 = 0").withColumn("created_nano", F.col("telegram_id") * F.lit(10**9))
    o = derive.table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))).otherwise("")
    new = o.select("o_orderkey", (F.col("o_custkey") + 1).alias("telegram_id"), name.alias("username"), (F.col("o_orderstatus") == "F").alias("active"), times.nanos(F.col("o_orderdate").cast("timestamp")).alias("created_nano"))
    return store.save_subscribers(s, new, "o_orderkey").select("telegram_id", "username", "active", "created_nano")


def repeated_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event saves its user's delivery: what a save makes terminal stays so, cursor and creation are the first."""
    e = derive.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "retry").when(F.col("event_id") % 23 == 0, "sent").otherwise("due")
    new = e.select("event_id", F.col("user_id").cast("string").alias("id"), status.alias("status"), (F.col("event_id") % 3).cast("int").alias("attempt"), (F.col("event_id") % 4).cast("int").alias("confirmed_through"), times.nanos(F.col("ts")).alias("created_nano"))
    old = e.where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("id"), "user_id").distinct()
    old = old.select("id", F.when(F.col("user_id") % 10 == 0, "blocked").otherwise("due").alias("status"), F.lit(9).alias("attempt"), F.lit(7).alias("confirmed_through"), F.lit(5).cast("long").alias("created_nano"))
    return store.save_deliveries(old, new, delivery.TERMINAL, "event_id").select("id", "status", "attempt", "confirmed_through", "created_nano")


def default_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions that orders stand for, from people of whom every third has preferences: the others get the defaults."""
    p = derive.preferences(spark, sf_dir).where("telegram_id % 3 = 0")
    o = derive.table(spark, sf_dir, "orders").select((F.col("o_custkey") + 1).alias("telegram_id"), F.col("o_orderpriority").alias("source_id"))
    _, after = store.save_subscriptions(o.limit(0), p, o, DEFAULTS)
    return after.select("telegram_id", F.array_join("regions", ",").alias("regions"), F.array_join("categories", ",").alias("categories"), "delivery_time", "timezone", "max_items")


def digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored digests: their lines are items in order of price, so that ranks have no gaps."""
    li, p = derive.table(spark, sf_dir, "lineitem"), derive.table(spark, sf_dir, "part")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber"))
    return rows.select("l_orderkey", nth.alias("place"), F.col("p_name").alias("startup_name"), F.concat(F.lit("https://src.example/"), F.col("l_suppkey").cast("string")).alias("source_url"), F.col("p_brand").alias("source_id"))


def stored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each delivery's stored digest, as of the version that was stored when it was queued: every item has another
    name since, and open orders have lost theirs."""
    rows = digest_rows(spark, sf_dir)
    base = new_base(spark, "digests")
    first = versions.commit(spark, base, {"items": rows})
    queued = versions.commit(spark, base, {"queue": derive.deliveries(spark, sf_dir).select("id", "digest_date", F.substring_index("id", "_", -1).cast("long").alias("l_orderkey"))}, before=first)
    # as stored, rather than ranked once more
    items = versions.read(spark, base, "items", rows.schema, versions.manifest(spark, base, queued["version"]))
    versions.commit(spark, base, {"items": items.where("l_orderkey % 2 = 0").withColumn("startup_name", F.lit("changed"))}, before=queued)
    queue = versions.read(spark, base, "queue", spark.createDataFrame([], "id string, digest_date string, l_orderkey bigint").schema, versions.current(spark, base))
    none = F.array().cast("array<string>")
    nothing = F.struct(*[F.lit("").alias(c) for c in ("round", "amount", "currency")], none.alias("investors"))
    lists = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("place", "startup_name", "source_id", "source_url"))).alias("rows"))
    item = lambda r: F.struct(r["place"].alias("place"), r["startup_name"].alias("startup_name"), F.lit("").alias("description"), F.lit("launch").alias("signal_type"), F.lit("").alias("region"), none.alias("categories"), nothing.alias("funding"), F.array(F.struct(r["source_id"].alias("source_id"), r["source_url"].alias("source_url"))).alias("sources"))
    digests = queue.join(lists, "l_orderkey", "left").select("id", "digest_date", F.lit("UTC").alias("timezone"), F.transform(F.coalesce("rows", F.array().cast(lists.schema["rows"].dataType)), item).alias("items"))
    return render.messages(digests, 1 << 20)  # one message for each


def receipt_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that orders as deliveries break, each planted in some of them."""
    k = F.col("l_orderkey")
    # ranked and written once: all that is made of the lines reads them, and finds those of an order together
    rows = staged(digest_rows(spark, sf_dir)).withColumns({"delivery_id": F.concat(F.lit("del_"), k.cast("string")), "digest_id": F.concat(F.lit("dig_"), k.cast("string"))})
    good = F.to_json(F.array(F.struct("source_id", "source_url")))
    bare = F.to_json(F.array(F.struct(F.lit(" ").alias("source_id"), "source_url")))
    local = F.to_json(F.array(F.struct("source_id", F.lit("https://localhost/x").alias("source_url"))))
    written = F.when(k % 47 == 0, "{").when(k % 47 == 1, "[]").when(k % 47 == 2, bare).when(k % 47 == 3, local).when(k % 47 == 4, "[3]").otherwise(good)
    identity = F.when((k % 53 == 0) & (F.col("place") == 1), "").otherwise(F.concat(F.lit("c"), "place"))
    items = rows.select("digest_id", F.when(k % 17 == 0, F.col("place") + 1).otherwise(F.col("place")).alias("rank"), identity.alias("candidate_identity"), "startup_name", written.alias("attributions_json"))
    name = F.when(k % 19 == 0, "somebody").otherwise(F.col("startup_name"))
    label, url = F.when(k % 37 == 0, "От:").otherwise(receipts.SOURCES), F.when(k % 31 == 0, "https://other.example/").otherwise(F.col("source_url"))
    text = F.concat(F.lit("<b>"), name, F.lit("</b> "), label, F.lit(' <a href="'), url, F.lit('">s</a>'))
    messages = rows.select("delivery_id", (F.col("place") - 1).alias("at"), F.when(k % 29 == 0, F.col("place") * 2).otherwise(F.col("place")).alias("sequence"), text.alias("text"), F.when(k % 23 > 0, "HTML").alias("parse_as"))
    attempts = rows.where(~((k % 41 == 0) & (F.col("place") == 1))).select("delivery_id", F.lit("success").alias("status"), F.when(k % 43 == 0, "").otherwise("m").alias("message_id"))
    n = rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    o = derive.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(n, "l_orderkey", "left").na.fill(0, ["n"])
    deliveries = o.select(F.concat(F.lit("del_"), k.cast("string")).alias("delivery_id"), F.concat(F.lit("dig_"), k.cast("string")).alias("digest_id"), F.lit(1).alias("attempt"), F.when(k % 59 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("confirmed_through"))
    runs = o.select(F.concat(F.lit("dig_"), k.cast("string")).alias("digest_id"), F.when(k % 13 == 0, -1).when(k % 11 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("candidate_count"))
    health = derive.source_health(spark, sf_dir).where("status IN ('ok', 'skipped', 'zero_yield')")
    return receipts.violations(deliveries, runs, items, messages, attempts, health)


def delivery_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest delivery of each subscriber with its digest and attempts: orders, their lines by price, and events dealt to
    the orders."""
    d = derive.deliveries(spark, sf_dir).withColumn("digest_id", F.concat(F.lit("dig_"), F.substring_index("id", "_", -1)))
    rows = digest_rows(spark, sf_dir)
    items = rows.select(F.concat(F.lit("dig_"), F.col("l_orderkey").cast("string")).alias("digest_id"), F.col("place").alias("rank"), F.concat(F.lit("i"), F.col("place").cast("string")).alias("id"), F.lit("c").alias("candidate_identity"), "startup_name")
    k = F.substring_index("id", "_", -1).cast("long")
    runs = d.where(k % 7 > 0).select("digest_id", (k % 20).cast("int").alias("candidate_count"))
    n = derive.table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    e = derive.attempts(spark, sf_dir)
    attempts = e.select(F.concat(F.lit("del_"), (F.col("event_id") * 7 % n).cast("string")).alias("delivery_id"), "attempt_id", "attempted_nano", "status", F.when(F.col("status") == "success", F.concat(F.lit("m"), F.col("event_id").cast("string"))).alias("message_id"))
    got = delivery.snapshot(d, runs, items, attempts)
    shown = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["rank"].cast("string"), i["startup_name"])), ",")
    told = F.array_join(F.transform("attempts", lambda a: F.concat_ws("=", a["status"], a["message_id"])), ",")
    return got.select("telegram_id", "id", "digest_id", "status", "attempt", "confirmed_through", "candidate_count", shown.alias("items"), told.alias("attempts"))


def upsert_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that are saved again, every second of them twice: the last save replaces the whole row, others stay."""
    a = derive.attempts(spark, sf_dir).select("attempt_id", "delivery_id", "attempted_nano", "status", "event_id")
    new = a.where("event_id % 2 = 0").withColumn("nth", F.explode(F.array(F.lit(2), F.lit(1))))
    new = new.withColumns({"status": F.concat("status", F.lit("-"), F.col("nth").cast("string")), "attempted_nano": F.col("attempted_nano") + F.col("nth")})
    old = a.where("event_id % 3 > 0")
    return store.upsert(old, store.last_by(new, ["attempt_id"], ["nth"]), ["attempt_id"]).drop("event_id")


def upsert_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of digests and their items, saved one by one: a run that is there is replaced, and so is an item of the same id."""
    o = derive.table(spark, sf_dir, "orders")
    runs = o.select(F.concat(F.lit("dig_"), F.col("o_orderkey").cast("string")).alias("digest_id"), F.col("o_orderkey").alias("k"), F.lit("old").alias("state"))
    after = store.upsert(runs.where("k % 4 > 0"), runs.where("k % 3 = 0").withColumn("state", F.lit("new")), ["digest_id"])
    items = digest_rows(spark, sf_dir).select(F.concat(F.lit("dig_"), F.col("l_orderkey").cast("string")).alias("digest_id"), "place", "startup_name", F.col("l_orderkey").alias("k"))
    changed = items.where("k % 3 = 0 AND place % 2 = 0").withColumn("startup_name", F.upper("startup_name"))
    shown = store.upsert(items, changed, ["digest_id", "place"])
    return after.join(shown.drop("k"), "digest_id").select("digest_id", "state", F.col("place").cast("int").alias("place"), "startup_name")


def shown_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers and their preferences as a service shows them."""
    p = derive.preferences(spark, sf_dir).where("telegram_id % 5 > 0")
    regions = F.when(F.col("telegram_id") % 3 > 0, F.col("regions"))
    return preferences.contracts(derive.subscribers(spark, sf_dir), p.withColumn("regions", regions))


def sent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the answers to a delivery's messages in order of time: its reports, as far as the first failure."""
    e = derive.table(spark, sf_dir, "events")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select(F.col("user_id").alias("delivery_id"), nth.alias("at"), "event_id", times.nanos(F.col("ts")).alias("attempted_nano"), "event_type")
    answer = F.when(F.col("event_id") % 6 > 0, "ok").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "signup", "blocked").when(F.col("event_type") == "purchase", "unavailable").otherwise("ok")
    messages = rows.select("delivery_id", "at", F.when(F.col("event_id") % 31 > 0, F.col("at")).otherwise(0).alias("sequence"), "attempted_nano", answer.alias("answer"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"), F.lit("400").alias("error_code"))
    return worker.reports(messages)


def backfilled_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events from their stored text, range after range, stopped after two of them and gone on with."""
    e = derive.table(spark, sf_dir, "events")
    shown = F.when(F.col("event_id") % 13 == 0, "yesterday").otherwise(times.rfc3339(times.nanos(F.col("ts")) + F.col("event_id") % 1000))
    rows = e.select("event_id", shown.alias("stamp"), F.when(F.col("event_id") % 2 == 0, times.nanos(F.col("ts"))).alias("nano"))
    base, value = new_base(spark, "backfill"), times.parse_rfc3339(F.col("stamp"))
    n = -(-rows.where("nano IS NULL").count() // 5)
    backfill.run(rows, base, "event_id", "nano", value, batch=n, most=2)
    backfill.run(rows, base, "event_id", "nano", value, batch=n)
    return backfill.filled(rows, base, "event_id", "nano")


def backfilled_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.attempt_times(derive.source_health(spark, sf_dir)).select("source_id", "status", "last_attempt_nano")


def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries in files of three versions of a schema, a third of the orders each: with the columns that came later at their
    defaults, and nulls that were written kept."""
    d = derive.deliveries(spark, sf_dir)
    number = F.substring_index("id", "_", -1).cast("long")
    names = {1: ["id", "status"], 2: ["id", "status", "attempt"], 3: ["id", "status", "attempt", "next_attempt_nano", "reason"]}
    base = new_base(spark, "schemas")
    for v, columns in names.items():
        d.where(number % 3 == v - 1).withColumns({"reason": F.when(number % 2 == 0, "told"), "next_attempt_nano": F.col("next_attempt_nano")}).select(*columns).write.parquet(f"{base}/v{v}")
    schemas = {v: d.withColumn("reason", F.lit("").cast("string")).select(*columns).schema for v, columns in names.items()}
    defaults = {"attempt": F.lit(0), "next_attempt_nano": F.lit(0).cast("long"), "reason": F.lit("")}
    return store.read_versions(spark, {v: f"{base}/v{v}" for v in names}, schemas, defaults)


def stored_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored times, read back from text: nanoseconds, empty ones, and text that is no time."""
    e = derive.table(spark, sf_dir, "events")
    nano = times.nanos(F.col("ts")) + F.col("event_id") % 1000
    shown = F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 13 == 0, "yesterday").otherwise(times.rfc3339(nano))
    return store.migrated(e.select("event_id", shown.alias("stamp")), {"nano": times.parse_rfc3339(F.col("stamp")), "note": F.lit("")})


def attempt_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of reports, with and without a sequence; markup in the message is escaped as in stored JSON."""
    a = derive.attempts(spark, sf_dir)
    seconds = F.lit(START) + F.col("event_id") % 1_000_000
    said = F.concat(F.lit("<"), F.col("status"), F.lit("> & more"))
    sequence = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 3).cast("int"))
    return a.select("event_id", identity.attempt_id(F.col("delivery_id").cast("string"), seconds * F.lit(10**9), F.col("status"), sequence, F.col("event_id"), F.lit("e"), said).alias("id"))


def failure_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure texts of sources: secrets out, each message once, kinds that are not public hidden."""
    s = derive.source_health(spark, sf_dir)
    note = F.concat(F.lit("token s3cret of "), F.col("status"))
    twice = text.append_once(text.append_once(text.redact(note, ["s3cret", ""]), F.lit("timeout")), F.when(F.col("status") == "ok", "timeout").otherwise(F.col("status")))
    return s.select("source_id", twice.alias("notes"), text.shown_failure(F.when(F.col("status") == "failed", "timeout").otherwise(F.col("status"))).alias("kind"))


def schedule_after_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run is due that may have run today already."""
    p = derive.preferences(spark, sf_dir)
    last = F.when(F.col("telegram_id") % 3 > 0, F.lit(NOW_NANO) - F.col("telegram_id") % 48 * F.lit(3600 * 10**9))
    return p.select("telegram_id", times.schedule_due(NOW, NOW_NANO, F.col("timezone"), F.col("delivery_time"), last).alias("due"))


def catalog_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derive.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    rows = s.select(
        F.when(k % 7 == 1, "\t").when(k % 7 == 2, "same").otherwise(F.col("s_name")).alias("source_id"),
        F.when(k % 7 == 3, " ").otherwise(F.col("s_name")).alias("display_name"),
        F.when(k % 7 == 4, "ftp").otherwise("rss").alias("access_method"),
        F.concat(F.when(k % 7 == 5, "http").otherwise("https"), F.lit("://x.example/"), k.cast("string")).alias("url"),
        F.when(k % 7 == 6, 0).otherwise(60).cast("long").alias("cadence_nano"),
    )
    return resolution.bad_catalog(rows).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "store_subscribers": store_subscribers, "store_subscriptions": store_subscriptions, "store_preferences": store_preferences, "digest_snapshots": digest_snapshots, "digest_of_delivery": digest_of_delivery,
    "attempts_of_delivery": attempts_of_delivery, "ingested_sources": ingested_sources, "stored_times": stored_times, "attempt_ids": attempt_ids, "failure_notes": failure_notes,
    "schedule_after_last": schedule_after_last, "catalog_problems": catalog_problems, "repeated_health": repeated_health, "repeated_subscribers": repeated_subscribers,
    "repeated_deliveries": repeated_deliveries, "default_preferences": default_preferences, "stored_messages": stored_messages, "receipt_violations": receipt_violations, "delivery_snapshot": delivery_snapshot, "upsert_attempts": upsert_attempts, "upsert_runs": upsert_runs, "shown_subscribers": shown_subscribers, "sent_messages": sent_messages,
    "backfilled_times": backfilled_times, "backfilled_attempts": backfilled_attempts, "schema_versions": schema_versions,
}

LINES = "l AS (SELECT 'dig_' || l_orderkey AS digest_id, l_linenumber::INTEGER AS rank, p_name AS startup_name, l_quantity::INTEGER AS quantity, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)"
RANKED = "r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber) AS place, p_name AS startup_name, 'https://src.example/' || l_suppkey AS source_url, p_brand AS source_id FROM lineitem JOIN part ON l_partkey = p_partkey)"
ORACLE_SQL = {
    "store_subscribers": f"{with_('subscribers')} SELECT telegram_id, CASE WHEN active THEN upper(username) ELSE username END AS username, NOT active AS active, telegram_id * 1000000000 AS created_nano FROM subscribers",
    "store_subscriptions": "SELECT o_custkey + 1 AS telegram_id, o_orderpriority AS source_id, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'old' ELSE 'new' END AS origin FROM orders GROUP BY ALL",
    "store_preferences": f"""{with_('preferences')} SELECT telegram_id, CASE WHEN telegram_id % 3 = 0 THEN 'EUROPE' ELSE region END AS regions, category AS categories, CASE WHEN telegram_id % 5 = 0 THEN '09:00' ELSE delivery_time END AS delivery_time,
CASE WHEN telegram_id % 4 = 0 THEN 'UTC' ELSE timezone END AS timezone, CASE WHEN max_items < 1 OR max_items > 10 THEN 10 WHEN max_items < 5 THEN 5 ELSE max_items END AS max_items FROM preferences""",
    "digest_snapshots": f"WITH {LINES} SELECT digest_id, rank, startup_name, quantity FROM l JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' OR quantity > 40",
    "digest_of_delivery": f"""{with_('deliveries')}, {LINES} SELECT d.id, d.status, count(l.rank)::INTEGER AS n_items, coalesce(string_agg(l.rank || ':' || l.startup_name || ':' || l.quantity, ',' ORDER BY l.rank, l.startup_name, l.quantity), '') AS items
FROM deliveries d LEFT JOIN l ON l.digest_id = 'dig_' || split_part(d.id, '_', 2) GROUP BY d.id, d.status""",
    "attempts_of_delivery": f"{with_('attempts')} SELECT delivery_id, count(*)::INTEGER AS n, string_agg(attempt_id || '=' || status, ',' ORDER BY attempted_nano, attempt_id, status) AS attempts FROM attempts GROUP BY delivery_id",
    "ingested_sources": f"""{with_('health')}, h AS (SELECT *, status = 'ok' AND split_part(source_id, '#', 2)::BIGINT % 4 <> 1 AS taken FROM health)
SELECT source_id, CASE WHEN taken THEN 'new' ELSE 'old' END AS startup_name, CASE WHEN taken THEN {NOW_NANO} ELSE last_ingestion_nano END AS published_nano, status, CASE WHEN taken THEN {NOW_NANO} ELSE last_ingestion_nano END AS last_ingestion_nano FROM h""",
    "repeated_health": f"""{with_('health')}, n AS (SELECT s_name AS source_id, last(CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'ok' END ORDER BY l_orderkey, l_linenumber, l_partkey) AS status,
  last(epoch_us(l_shipdate::TIMESTAMP) * 1000 ORDER BY l_orderkey, l_linenumber, l_partkey) AS ingested, last(epoch_us(l_shipdate::TIMESTAMP) * 1000 - 1 ORDER BY l_orderkey, l_linenumber, l_partkey) FILTER (l_partkey % 3 = 0) AS attempted
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1), old AS (SELECT * FROM health WHERE split_part(source_id, '#', 2)::BIGINT % 3 <> 0)
SELECT source_id, coalesce(n.status, old.status) AS status, coalesce(ingested, last_ingestion_nano) AS last_ingestion_nano, coalesce(attempted, last_attempt_nano) AS last_attempt_nano FROM n FULL JOIN old USING (source_id)""",
    "repeated_subscribers": f"""{with_('subscribers')}, n AS (SELECT o_custkey + 1 AS telegram_id, coalesce(last('u' || o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 3 > 0), '') AS username, last(o_orderstatus = 'F' ORDER BY o_orderkey) AS active, first(epoch_us(o_orderdate::TIMESTAMP) * 1000 ORDER BY o_orderkey) AS created_nano FROM orders GROUP BY 1),
old AS (SELECT *, telegram_id * 1000000000 AS created_nano FROM subscribers WHERE telegram_id % 2 = 0)
SELECT telegram_id, CASE WHEN n.username <> '' OR old.username IS NULL THEN n.username ELSE old.username END AS username, coalesce(n.active, old.active) AS active, coalesce(old.created_nano, n.created_nano) AS created_nano FROM n FULL JOIN old USING (telegram_id)""",
    "repeated_deliveries": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'retry' WHEN event_id % 23 = 0 THEN 'sent' ELSE 'due' END AS status, (event_id % 3)::INTEGER AS attempt, (event_id % 4)::INTEGER AS confirmed, epoch_us(ts) * 1000 AS nano FROM events),
n AS (SELECT user_id, first(confirmed ORDER BY event_id) AS confirmed, first(nano ORDER BY event_id) AS nano, coalesce(first(status ORDER BY event_id) FILTER (status = 'sent'), last(status ORDER BY event_id)) AS status,
  coalesce(first(attempt ORDER BY event_id) FILTER (status = 'sent'), last(attempt ORDER BY event_id)) AS attempt FROM e GROUP BY 1)
SELECT user_id::VARCHAR AS id, CASE WHEN user_id % 10 = 0 THEN 'blocked' ELSE status END AS status, CASE WHEN user_id % 10 = 0 THEN 9 ELSE attempt END AS attempt, CASE WHEN user_id % 2 = 0 THEN 7 ELSE confirmed END AS confirmed_through, CASE WHEN user_id % 2 = 0 THEN 5 ELSE nano END AS created_nano FROM n""",
    "default_preferences": f"""{with_('preferences')} SELECT telegram_id, region AS regions, category AS categories, delivery_time, timezone, max_items FROM preferences WHERE telegram_id % 3 = 0
UNION ALL SELECT DISTINCT o_custkey + 1, 'EUROPE', 'AI', '09:00', 'UTC', 10 FROM orders WHERE (o_custkey + 1) % 3 <> 0""",
    "stored_messages": f"""{with_('deliveries')}, {RANKED}, b AS (SELECT l_orderkey, string_agg(place || '. <b>' || startup_name || '</b>' || chr(10) || '📝 <b>Описание:</b> Стартап с актуальным сигналом: запуск.' || chr(10)
  || '💡 <b>Почему интересно:</b> Свежий запуск показывает, что продукт уже представлен рынку.' || chr(10) || '📣 Сигнал: запуск' || chr(10) || '🔗 Источники: <a href="' || source_url || '">' || source_id || '</a>', chr(10) || chr(10) ORDER BY place) AS blocks FROM r GROUP BY 1)
SELECT id, 1 AS sequence, '🚀 <b>Стартапы дня</b>' || chr(10) || '<i>' || day(digest_date::DATE) || ' ' || {list(render.MONTHS)}[month(digest_date::DATE)] || ' ' || year(digest_date::DATE) || ' · UTC</i>' || chr(10) || chr(10) || coalesce(blocks, '{render.EMPTY}') AS text
FROM deliveries LEFT JOIN b ON l_orderkey = split_part(id, '_', 2)::BIGINT""",
    "receipt_violations": f"""WITH {RANKED}, n AS (SELECT o_orderkey AS k, coalesce(n, 0) AS n, coalesce(names, 0) AS names FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT startup_name) AS names FROM r GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT 'del_' || k AS delivery_id, unnest(list_filter([CASE WHEN n > 10 THEN 'digest_item_limit_exceeded' END, CASE WHEN k % 13 = 0 THEN 'candidate_count_invalid' END,
  CASE WHEN n <> least(CASE WHEN k % 13 = 0 THEN -1 WHEN k % 11 = 0 THEN n + 1 ELSE n END, 10) THEN 'digest_candidate_count_mismatch' END, CASE WHEN n > 0 AND k % 17 = 0 THEN 'digest_rank_invalid' END,
  CASE WHEN n > 0 AND k % 53 = 0 THEN 'digest_candidate_identities_not_unique' END, CASE WHEN n > 0 AND k % 47 IN (0, 2, 4) THEN 'attribution_invalid' END, CASE WHEN n > 0 AND k % 47 = 1 THEN 'attribution_missing' END,
  CASE WHEN n > 0 AND k % 47 = 3 THEN 'publisher_link_invalid' END, CASE WHEN n = 0 THEN 'rendered_messages_missing' END, CASE WHEN n > 0 AND k % 23 = 0 THEN 'rendered_message_invalid' END, CASE WHEN n > 0 AND k % 29 = 0 THEN 'rendered_sequence_invalid' END,
  CASE WHEN n > 0 AND k % 37 = 0 THEN 'rendered_attribution_missing' END, CASE WHEN n BETWEEN 1 AND 10 AND k % 19 = 0 THEN 'rendered_item_missing' END, CASE WHEN n > 0 AND k % 31 = 0 AND k % 47 > 4 THEN 'rendered_publisher_link_missing' END,
  CASE WHEN k % 59 = 0 OR (n > 0 AND (k % 41 = 0 OR k % 43 = 0)) THEN 'telegram_ack_missing' END], lambda x: x IS NOT NULL)) AS kind FROM n""",
    "delivery_snapshot": f"""{with_('deliveries', 'attempts')}, {RANKED}, d AS (SELECT *, split_part(id, '_', 2)::BIGINT AS k FROM deliveries QUALIFY row_number() OVER (PARTITION BY telegram_id ORDER BY created_nano DESC, id DESC) = 1),
i AS (SELECT l_orderkey AS k, string_agg(place || ':' || startup_name, ',' ORDER BY place) AS items FROM r GROUP BY 1),
a AS (SELECT event_id * 7 % (SELECT max(o_orderkey) + 1 FROM orders) AS k, string_agg(CASE status WHEN 'success' THEN 'success=m' || event_id ELSE status END, ',' ORDER BY attempted_nano, attempt_id) AS attempts FROM attempts GROUP BY 1)
SELECT telegram_id, id, 'dig_' || k AS digest_id, status, attempt, confirmed_through, (k % 20)::INTEGER AS candidate_count, coalesce(items, '') AS items, coalesce(attempts, '') AS attempts FROM d LEFT JOIN i USING (k) LEFT JOIN a USING (k) WHERE k % 7 > 0""",
    "upsert_attempts": f"""{with_('attempts')} SELECT attempt_id, delivery_id, attempted_nano + CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS attempted_nano, status || CASE WHEN event_id % 2 = 0 THEN '-2' ELSE '' END AS status
FROM attempts WHERE event_id % 2 = 0 OR event_id % 3 > 0""",
    "upsert_runs": f"""WITH {RANKED} SELECT 'dig_' || l_orderkey AS digest_id, CASE WHEN l_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS state, place::INTEGER AS place, CASE WHEN l_orderkey % 3 = 0 AND place % 2 = 0 THEN upper(startup_name) ELSE startup_name END AS startup_name
FROM r JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 4 > 0 OR l_orderkey % 3 = 0""",
    "shown_subscribers": f"""{with_('subscribers', 'preferences')} SELECT s.telegram_id, '{{"telegram_id":' || s.telegram_id || ',"username":"' || username || '","active":' || active || '}}' AS subscriber,
'{{"regions":[' || CASE WHEN p.telegram_id % 3 > 0 THEN '"' || region || '"' ELSE '' END || '],"categories":["' || category || '"],"delivery_time":"' || delivery_time || '","timezone":"' || timezone || '","max_items":' || max_items || '}}' AS preferences
FROM subscribers s LEFT JOIN preferences p ON p.telegram_id = s.telegram_id AND p.telegram_id % 5 > 0""",
    "sent_messages": f"""WITH e AS (SELECT user_id AS delivery_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, event_id, epoch_us(ts) * 1000 AS attempted_nano,
  CASE WHEN event_id % 6 > 0 THEN 'ok' ELSE CASE event_type WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'blocked' WHEN 'purchase' THEN 'unavailable' ELSE 'ok' END END AS answer, event_id % 31 > 0 AS sound FROM events),
w AS (SELECT *, coalesce(max(CASE WHEN NOT sound OR answer <> 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY delivery_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM e)
SELECT delivery_id, place::INTEGER AS "at", attempted_nano, CASE answer WHEN 'ok' THEN 'success' WHEN 'blocked' THEN 'blocked' ELSE 'failed' END AS status, place::INTEGER AS sequence, CASE answer WHEN 'ok' THEN 'm' || event_id END AS message_id,
CASE WHEN answer IN ('rejected', 'blocked') THEN '400' END AS error_code, CASE WHEN answer IN ('rejected', 'blocked') THEN '{worker.REJECTED}' WHEN answer <> 'ok' THEN '{worker.UNAVAILABLE}' END AS error_message FROM w WHERE stopped = 0 AND sound""",
    "backfilled_times": f"""WITH e AS (SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS n, ts, event_id % 13 = 0 AS bad FROM events)
SELECT event_id, CASE WHEN bad THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim('.' || lpad((n % 1000000000)::VARCHAR, 9, '0'), '0'), '.') || 'Z' END AS stamp,
CASE WHEN event_id % 2 = 0 THEN n - event_id % 1000 WHEN bad THEN {times.CORRUPT} ELSE n END AS nano FROM e""",
    "backfilled_attempts": f"{with_('health')} SELECT source_id, status, CASE WHEN last_attempt_nano IS NULL AND status IN ('ok', 'failed', 'fetching') THEN last_ingestion_nano ELSE last_attempt_nano END AS last_attempt_nano FROM health",
    "schema_versions": f"""{with_('deliveries')}, d AS (SELECT *, split_part(id, '_', 2)::BIGINT AS k FROM deliveries)
SELECT id, status, CASE WHEN k % 3 > 0 THEN attempt ELSE 0 END AS attempt, CASE WHEN k % 3 = 2 THEN next_attempt_nano ELSE 0 END AS next_attempt_nano, CASE WHEN k % 3 <> 2 THEN '' WHEN k % 2 = 0 THEN 'told' END AS reason FROM d""",
    "stored_times": f"""WITH e AS (SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS n, ts FROM events),
s AS (SELECT event_id, n, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim('.' || lpad((n % 1000000000)::VARCHAR, 9, '0'), '0'), '.') || 'Z' END AS stamp FROM e)
SELECT event_id, stamp, CASE stamp WHEN '' THEN NULL WHEN 'yesterday' THEN {times.CORRUPT} ELSE n END AS nano, '' AS note FROM s""",
    "attempt_ids": f"""{with_('attempts')}, j AS (SELECT event_id, '{{"delivery_id":"' || delivery_id || '","attempted_at":"' || strftime(make_timestamp(({START} + event_id % 1000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '","status":"' || status || '",'
|| CASE WHEN event_id % 2 = 0 THEN '"sequence":' || (event_id % 3) || ',' ELSE '' END || '"telegram_message_id":' || event_id || ',"error_code":"e","error_message":"\\u003c' || status || '\\u003e \\u0026 more"}}' AS t FROM attempts)
SELECT event_id, 'attempt-' || sha256(t) AS id FROM j""",
    "failure_notes": f"""{with_('health')} SELECT source_id, 'token [redacted] of ' || status || '; timeout' || CASE status WHEN 'ok' THEN '' ELSE '; ' || status END AS notes, CASE status WHEN 'failed' THEN 'timeout' ELSE 'network' END AS kind FROM health""",
    "schedule_after_last": f"""{with_('preferences')}, a AS (SELECT *, epoch_us((strftime(TIMESTAMPTZ '{NOW}+00' AT TIME ZONE timezone, '%Y-%m-%d') || ' ' || delivery_time || ':00')::TIMESTAMP AT TIME ZONE timezone) * 1000 AS due_nano FROM preferences)
SELECT telegram_id, {NOW_NANO} >= due_nano AND (telegram_id % 3 = 0 OR {NOW_NANO} - telegram_id % 48 * 3600000000000 < due_nano) AS due FROM a""",
    "catalog_problems": """SELECT CASE k WHEN 1 THEN 'id' WHEN 2 THEN 'duplicate' WHEN 3 THEN 'name' WHEN 4 THEN 'access_method' WHEN 5 THEN 'url' WHEN 6 THEN 'cadence' END AS problem, CASE WHEN k <= 2 THEN 1 ELSE n END AS n
FROM (SELECT s_suppkey % 7 AS k, count(*) AS n FROM supplier GROUP BY 1) WHERE k > 0 AND (k <> 2 OR n > 1)""",
}
