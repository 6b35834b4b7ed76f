"""The relations of the digest domain, derived from the tables of a scale-factor folder.

The tables hold no feed, so each relation is a fixed formula over them; SQL has the same formulas as common table
expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.times import nanos

NOW = "2024-01-08 12:00:00"
NOW_NANO = 1_704_715_200 * 10**9
START = 1_704_067_200  # 2024-01-01
ZONES = ("UTC", "Europe/Berlin", "America/New_York", "Asia/Tokyo", "America/Sao_Paulo", "Asia/Kolkata")
KINDS = ("funding", "launch", "award", "acquisition", "ranking", "news", "other")
TYPES = ("STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def element(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select((F.col("c_custkey") + 1).alias("telegram_id"), F.col("c_name").alias("username"), (F.col("c_acctbal") >= 0).alias("active"))


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        (F.col("c_custkey") + 1).alias("telegram_id"),
        F.array("r_name").alias("regions"),
        F.array(element(TYPES, F.col("c_custkey") % 6)).alias("categories"),
        F.concat(F.lpad((F.col("c_custkey") % 24).cast("string"), 2, "0"), F.lit(":00")).alias("delivery_time"),
        element(ZONES, F.col("c_nationkey") % 6).alias("timezone"),
        (F.col("c_custkey") % 14).cast("int").alias("max_items"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation", "region"))
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    seconds = F.lit(START) + F.col("l_orderkey") % 14 * 86_400 + (F.col("l_partkey") * 37 + F.col("l_suppkey")) % 86_400
    paid = F.col("l_suppkey") % 3 == 0
    number = F.col("l_quantity").cast("int").cast("string")
    host = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), (F.col("l_suppkey") % 2).cast("string"))
    funding = F.struct(
        F.when(paid, element(("seed", "series a", ""), F.col("l_linenumber") % 3)).otherwise("").alias("round"),
        F.when(paid, F.concat(number, F.lit(" million"))).otherwise("").alias("amount"),
        F.when(paid, F.lit("USD")).otherwise("").alias("currency"),
        F.when(paid & (F.col("l_linenumber") % 2 == 0), F.array(F.concat(F.lit("Fund "), (F.col("l_suppkey") % 7).cast("string")))).otherwise(F.array().cast("array<string>")).alias("investors"),
    )
    return rows.select(
        F.concat_ws("_", F.lit("sig"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.concat("p_name", element(("", " Ltd", " Inc", " LLC"), F.col("l_linenumber") % 4)).alias("startup_name"),
        F.when((F.col("l_partkey") + F.col("l_linenumber")) % 4 == 0, F.concat(F.lit("https://"), host, F.lit(".example"))).otherwise("").alias("canonical_url"),
        F.col("p_brand").alias("source_id"),
        F.concat(F.lit("https://src.example/"), (F.col("l_suppkey") % 50).cast("string")).alias("source_url"),
        element(KINDS, F.col("l_partkey") % 7).alias("signal_type"),
        (seconds * F.lit(10**9)).cast("long").alias("published_nano"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("about "), F.col("p_name"))).otherwise("").alias("description"),
        F.col("r_name").alias("region"),
        F.array("p_type").alias("categories"),
        funding.alias("funding"),
    )


def priority(source_id: F.Column) -> F.Column:
    """Brands have priorities from -3 to 9."""
    return (F.substring_index(source_id, "#", -1).cast("int") % 5 - 1) * 3


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    created = nanos(F.col("o_orderdate"))
    retry = F.col("o_orderstatus") == "P"
    return o.select(
        F.concat(F.lit("del_"), F.col("o_orderkey").cast("string")).alias("id"),
        (F.col("o_custkey") + 1).alias("telegram_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("digest_date"),
        F.when(F.col("o_orderstatus") == "O", "due").when(retry, "retry").otherwise("sent").alias("status"),
        F.when(retry, 1).otherwise(0).alias("attempt"),
        (F.col("o_orderkey") % 3).cast("int").alias("confirmed_through"),
        F.when(retry, created + F.col("o_orderkey") % 72 * F.lit(3600 * 10**9)).alias("next_attempt_nano"),
        created.alias("created_nano"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as delivery reports: the user is the delivery, in order of time."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "blocked").otherwise("success")
    return e.select(
        F.concat(F.lit("att_"), F.col("event_id").cast("string")).alias("attempt_id"),
        F.col("user_id").alias("delivery_id"),
        nanos(F.col("ts")).alias("attempted_nano"),
        F.col("event_id"),
        kind.alias("status"),
        F.col("event_type").isin("view", "click").alias("intermediate"),
    )


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    bal = F.col("s_acctbal")
    seen = (F.lit(START) + F.col("s_suppkey") % 200 * 3600).cast("long") * F.lit(10**9)
    return s.select(
        F.col("s_name").alias("source_id"),
        F.when(bal < 0, "failed").when(bal < 500, "zero_yield").when(bal < 1000, "config_error").when(bal < 1500, "skipped").otherwise("ok").alias("status"),
        seen.alias("last_ingestion_nano"),
        F.when(F.col("s_suppkey") % 5 != 0, seen - F.lit(60 * 10**9)).alias("last_attempt_nano"),
    )


#: The same relations in SQL.
CTE = {
    "subscribers": "subscribers AS (SELECT c_custkey + 1 AS telegram_id, c_name AS username, c_acctbal >= 0 AS active FROM customer)",
    "preferences": f"""preferences AS (
  SELECT c_custkey + 1 AS telegram_id, r_name AS region, {list(TYPES)}[c_custkey % 6 + 1] AS category,
         lpad((c_custkey % 24)::VARCHAR, 2, '0') || ':00' AS delivery_time, {list(ZONES)}[c_nationkey % 6 + 1] AS timezone, (c_custkey % 14)::INTEGER AS max_items
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "signals": f"""signals AS (
  SELECT 'sig_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id,
         p_name || ['', ' Ltd', ' Inc', ' LLC'][l_linenumber % 4 + 1] AS startup_name,
         CASE WHEN (l_partkey + l_linenumber) % 4 = 0 THEN 'https://' || replace(p_name, ' ', '-') || '-' || (l_suppkey % 2) || '.example' ELSE '' END AS canonical_url,
         p_brand AS source_id, 'https://src.example/' || (l_suppkey % 50) AS source_url, {list(KINDS)}[l_partkey % 7 + 1] AS signal_type,
         ({START} + l_orderkey % 14 * 86400 + (l_partkey * 37 + l_suppkey) % 86400) * 1000000000 AS published_nano,
         CASE WHEN l_linenumber % 2 = 0 THEN 'about ' || p_name ELSE '' END AS description, r_name AS region, p_type AS category,
         CASE WHEN l_suppkey % 3 = 0 THEN ['seed', 'series a', ''][l_linenumber % 3 + 1] ELSE '' END AS round,
         CASE WHEN l_suppkey % 3 = 0 THEN l_quantity::INTEGER || ' million' ELSE '' END AS amount,
         CASE WHEN l_suppkey % 3 = 0 THEN 'USD' ELSE '' END AS currency,
         CASE WHEN l_suppkey % 3 = 0 AND l_linenumber % 2 = 0 THEN 'Fund ' || (l_suppkey % 7) ELSE '' END AS investor
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "deliveries": """deliveries AS (
  SELECT 'del_' || o_orderkey AS id, o_custkey + 1 AS telegram_id, strftime(o_orderdate, '%Y-%m-%d') AS digest_date,
         CASE o_orderstatus WHEN 'O' THEN 'due' WHEN 'P' THEN 'retry' ELSE 'sent' END AS status,
         CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS attempt, (o_orderkey % 3)::INTEGER AS confirmed_through,
         CASE WHEN o_orderstatus = 'P' THEN epoch_us(o_orderdate) * 1000 + o_orderkey % 72 * 3600000000000 END AS next_attempt_nano,
         epoch_us(o_orderdate) * 1000 AS created_nano
  FROM orders)""",
    "attempts": """attempts AS (
  SELECT 'att_' || event_id AS attempt_id, user_id AS delivery_id, epoch_us(ts) * 1000 AS attempted_nano, event_id,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'blocked' ELSE 'success' END AS status, event_type IN ('view', 'click') AS intermediate
  FROM events)""",
    "health": f"""health AS (
  SELECT s_name AS source_id,
         CASE WHEN s_acctbal < 0 THEN 'failed' WHEN s_acctbal < 500 THEN 'zero_yield' WHEN s_acctbal < 1000 THEN 'config_error' WHEN s_acctbal < 1500 THEN 'skipped' ELSE 'ok' END AS status,
         ({START} + s_suppkey % 200 * 3600) * 1000000000 AS last_ingestion_nano,
         CASE WHEN s_suppkey % 5 <> 0 THEN ({START} + s_suppkey % 200 * 3600) * 1000000000 - 60000000000 END AS last_attempt_nano
  FROM supplier)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names)
