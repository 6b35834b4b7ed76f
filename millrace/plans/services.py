"""Queries over subscribers, deliveries, sources and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scoring
from millrace.operators import delivery, health, preferences, render, resolution, store
from millrace.plans import derive, digests
from millrace.plans.derive import START, with_
from millrace.session import spread

DUE_NANO = 946_684_800 * 10**9  # 2000-01-01, amid the orders
CADENCE_NANO = (START + 100 * 3600) * 10**9
AGAIN = 2 * 86_400 * 10**9


def local_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.subscribers(spark, sf_dir)


def due_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delivery.due(derive.deliveries(spark, sf_dir), local_subscribers(spark, sf_dir), DUE_NANO)
    return rows.select("id", "telegram_id", "status", "created_nano", "next_attempt_nano")


def pending_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derive.deliveries(spark, sf_dir)
    messages = d.select(F.col("id").alias("delivery_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("sequence"))
    return delivery.pending(messages, d).groupBy("delivery_id").agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("next"))


IN_ORDER = ("attempted_nano", "event_id", "attempt_id", "delivery_id")
HALF_DAY = 43_200 * 10**9


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports on deliveries of three messages: intermediate ones confirm one of the first two messages by
    turns, others report on the whole; every fifth is sent again after two days, and what was refused then is judged anew.
    The next delivery reports every seventh under the same id, half a day before, at the same time or half a day later."""
    a = derive.attempts(spark, sf_dir)
    part = F.when(F.col("intermediate"), F.col("event_id") % 2 + 1).otherwise(0).cast("int")
    rows = a.select(F.col("delivery_id"), "attempt_id", "event_id", "attempted_nano", "status", part.alias("sequence"), F.lit(3).alias("total"))
    again = rows.where("event_id % 5 = 0").withColumn("attempted_nano", F.col("attempted_nano") + AGAIN)
    shift = (F.col("event_id") % 3 - 1) * F.lit(HALF_DAY)
    others = rows.where("event_id % 7 = 0").withColumns({"delivery_id": F.col("delivery_id") + 1, "attempted_nano": F.col("attempted_nano") + shift})
    return rows.unionByName(again).unionByName(others)


def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = delivery.outcomes(reports(spark, sf_dir), *IN_ORDER)
    return out.select("delivery_id", "status", "attempt", "confirmed_through", "next_attempt_nano", "inactive", "accepted", "duplicate", "terminal", "conflict")


def shown_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as digest items of the order's delivery: attributions to the supplier and the part's brand."""
    li = derive.table(spark, sf_dir, "lineitem")
    scheme = F.when(F.col("l_suppkey") % 50 == 7, "http://").otherwise("https://")
    url = F.concat(scheme, F.lit("src.example/"), F.col("l_suppkey").cast("string"))
    one = F.struct(F.concat(F.lit("s"), (F.col("l_suppkey") % 40).cast("string")).alias("source_id"), url.alias("source_url"))
    none = F.array().cast("array<struct<source_id:string,source_url:string>>")
    return li.select(F.concat(F.lit("del_"), F.col("l_orderkey").cast("string")).alias("id"), F.when(F.col("l_partkey") % 90 == 5, none).otherwise(F.array(one)).alias("attributions"))


def display_policy(spark: SparkSession) -> DataFrame:
    return spark.range(40).where("id % 9 <> 4").select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_id"))


def suppressed_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = delivery.display(shown_items(spark, sf_dir), display_policy(spark), "id").where("NOT allowed")
    d = derive.deliveries(spark, sf_dir).withColumns({"suppression_reason": F.lit(None).cast("string"), "suppressed_source_ids": F.lit(None).cast("array<string>"), "suppressed_nano": F.lit(None).cast("long"), "catalog_revision": F.lit(None).cast("string")})
    # requests are made of what was read before: every seventh has an old cursor
    old = F.when(F.substring_index("id", "_", -1).cast("long") % 7 == 0, F.col("confirmed_through") + 1).otherwise(F.col("confirmed_through"))
    q = checked.join(d.select("id", "attempt", "confirmed_through"), "id").select("id", F.col("attempt").alias("expected_attempt"), old.alias("expected_confirmed"), F.lit("source_not_display_eligible").alias("reason"), F.col("offending").alias("source_ids"), F.lit(DUE_NANO).alias("at_nano"), F.lit("r1").alias("revision"))
    out = delivery.suppressed(d, q).where("answer IS NOT NULL")
    return out.select("id", "status", "answer", F.coalesce(F.array_join("suppressed_source_ids", ","), F.lit("")).alias("sources"), "suppressed_nano")


def latest_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.latest(derive.deliveries(spark, sf_dir)).select("telegram_id", "id", "status", "created_nano")


def by_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on the orders' deliveries."""
    return derive.attempts(spark, sf_dir).select(F.concat(F.lit("del_"), F.col("delivery_id").cast("string")).alias("delivery_id"), "attempted_nano")


def health_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.source_health(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("last_ingestion_nano").alias("last_ingestion_nano"))


def health_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.failures(derive.source_health(spark, sf_dir), derive.deliveries(spark, sf_dir), by_delivery(spark, sf_dir), 50)


def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.summary(derive.source_health(spark, sf_dir), local_subscribers(spark, sf_dir), derive.deliveries(spark, sf_dir), by_delivery(spark, sf_dir))


def source_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derive.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.when(k % 7 == 6, F.concat(F.lit("x"), "s_name")).otherwise(F.col("s_name")).alias("source_id"),
        (k % 3 != 0).alias("active"),
        F.when(k % 4 == 1, "rss").otherwise("atom").alias("access_method"),
        F.when(k % 2 == 0, F.array(F.lit("token"))).otherwise(F.array().cast("array<string>")).alias("credentials"),
        F.when(k % 11 != 0, F.lit(24 * 3600 * 10**9)).alias("cadence_nano"),
    )


def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derive.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_name").alias("source_id"), F.when(F.col("s_suppkey") % 8 == 1, "rss").otherwise("atom").alias("access_method"), F.when(F.col("s_suppkey") % 5 == 0, F.array(F.lit("token"))).otherwise(F.array().cast("array<string>")).alias("required"))


def source_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.resolved(source_config(spark, sf_dir), source_registry(spark, sf_dir)).select("source_id", "status", "detail")


def cadence_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.cadence_due(source_config(spark, sf_dir), derive.source_health(spark, sf_dir), CADENCE_NANO).select("source_id", "due")


def overlay_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.bad_overlay(source_config(spark, sf_dir), source_registry(spark, sf_dir))


def preference_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derive.preferences(spark, sf_dir)
    k = F.col("telegram_id")
    empty = F.array().cast("array<string>")
    patches = p.where(k % 3 != 0).select(
        "telegram_id",
        F.when(k % 5 == 0, F.array(F.lit("regions"))).otherwise(empty).alias("replace_fields"),
        F.when(k % 2 == 0, F.array(F.lit("EUROPE"), F.lit("ASIA"))).alias("regions"),
        F.lit(None).cast("array<string>").alias("categories"),
        F.when(k % 4 == 1, "07:30").alias("delivery_time"),
        F.when(k % 7 == 1, "Mars/Base").alias("timezone"),
        F.when(k % 6 == 1, F.lit(7)).alias("max_items"),
    )
    return preferences.patched(p, patches)


def preferences_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_patches(spark, sf_dir).select("telegram_id", F.array_join("regions", ",").alias("regions"), F.array_join("categories", ",").alias("categories"), "delivery_time", "timezone", "max_items")


def preferences_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preference_patches(spark, sf_dir)
    problem = preferences.invalid(F.col("delivery_time"), F.col("timezone"), F.col("max_items"), list(derive.ZONES))
    return rows.groupBy(F.coalesce(problem, F.lit("fine")).alias("problem"), scoring.item_limit(F.col("max_items")).alias("limit"), scoring.stored_limit(F.col("max_items")).alias("stored")).agg(F.count(F.lit(1)).alias("n"))


def preferences_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(derive.preferences(spark, sf_dir), "telegram_id")
    said = F.concat(F.lit("regions="), F.array_join("regions", ","), F.lit(",X  time="), "delivery_time", F.lit(" timezone="), F.when(F.col("telegram_id") % 4 == 0, "Nowhere").otherwise(F.col("timezone")), F.lit(" max="), F.col("max_items").cast("string"), F.when(F.col("telegram_id") % 5 == 0, " colour=red").otherwise(""))
    said = F.when(F.col("regions")[0] == "MIDDLE EAST", F.replace(said, F.lit("MIDDLE EAST"), F.lit("MIDDLE"))).otherwise(said)
    rows = p.select("telegram_id", preferences.parsed(said, list(derive.ZONES)).alias("p"))
    return rows.select("telegram_id", F.array_join("p.regions", ",").alias("regions"), F.col("p.delivery_time").alias("delivery_time"), F.col("p.timezone").alias("timezone"), F.col("p.max_items").alias("max_items"), F.array_join("p.errors", ",").alias("errors"))


def upsert_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed is replayed with some rows changed, those of a new source, and all of it twice."""
    s = derive.signals(spark, sf_dir).select("id", "startup_name", "source_id", "published_nano")
    old = s.where("source_id <> 'Brand#7'")
    new = s.where("published_nano % 2000000000 = 0 OR source_id = 'Brand#7'").withColumn("startup_name", F.upper("startup_name"))
    return store.save_signals(old, new.unionByName(new))


def upsert_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = derive.source_health(spark, sf_dir)
    old = h.where("substring_index(source_id, '#', -1) % 3 <> 0")
    new = h.where("substring_index(source_id, '#', -1) % 2 = 0 OR substring_index(source_id, '#', -1) % 3 = 0").withColumns({"status": F.lit("ok"), "last_attempt_nano": F.when(F.col("last_attempt_nano") % 7_000_000_000 == 0, F.col("last_attempt_nano") + 5)})
    return store.save_health(old, new)


def upsert_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derive.deliveries(spark, sf_dir)
    number = F.substring_index("id", "_", -1).cast("long")
    old = d.where(number % 4 != 0)
    new = d.where((number % 3 == 0) | (number % 4 == 0)).withColumns({"status": F.lit("retry"), "attempt": F.lit(2), "confirmed_through": F.lit(0), "created_nano": F.col("created_nano") + 1})
    return store.save_deliveries(old, new, delivery.TERMINAL).select("id", "status", "attempt", "confirmed_through", "created_nano")


def stored_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of a window as one digest for each source: its best ten."""
    from millrace.operators import selection

    c = digests.with_base(digests.candidates(spark, sf_dir))
    rows = c.withColumn("owner", F.col("sources")[0]["source_id"])
    ranked = selection.ranked(rows, "window_id", "owner").where("rank <= 10")
    item = F.struct(F.col("rank").alias("place"), "startup_name", "description", "signal_type", "region", "categories", "funding", "sources")
    return ranked.groupBy("window_id", "owner").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumns({"digest_date": F.substring_index("window_id", "|", -1), "timezone": F.substring_index("window_id", "|", 1)})


def render_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.messages(stored_digests(spark, sf_dir), 3000)


def render_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = digests.candidates(spark, sf_dir).withColumn("place", F.lit(1))
    i = F.struct("place", "startup_name", "description", "signal_type", "region", "categories", "funding", "sources")
    return render.with_blocks(c.select("window_id", "identity", i.alias("i"))).select("window_id", "identity", "block")


def translate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derive.table(spark, sf_dir, "region").select(F.col("r_name").alias("term"), render.translated(F.col("r_name"), render.REGIONS).alias("shown"))
    s = spark.createDataFrame([(x,) for x in ("series b", "Series  Z", " seed ", "series aa", "Bridge")], "term string")
    k = derive.signals(spark, sf_dir).select(F.col("signal_type").alias("term")).distinct()
    return r.unionByName(s.select("term", render.round_name(F.col("term")).alias("shown"))).unionByName(k.select("term", render.translated(F.col("term"), render.SIGNALS).alias("shown")))


QUERIES = {
    "due_deliveries": due_deliveries, "pending_messages": pending_messages, "delivery_outcomes": delivery_outcomes, "suppressed_deliveries": suppressed_deliveries, "latest_delivery": latest_delivery,
    "health_sources": health_sources, "health_failures": health_failures, "health_summary": health_summary, "source_resolution": source_resolution, "cadence_due": cadence_due,
    "overlay_problems": overlay_problems, "preferences_patch": preferences_patch, "preferences_valid": preferences_valid, "preferences_text": preferences_text, "upsert_signals": upsert_signals,
    "upsert_health": upsert_health, "upsert_deliveries": upsert_deliveries, "render_messages": render_messages, "render_items": render_items, "translate_terms": translate_terms,
}

CONFIG = """cfg AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 6 THEN 'x' || s_name ELSE s_name END AS source_id, s_suppkey % 3 <> 0 AS active, CASE WHEN s_suppkey % 4 = 1 THEN 'rss' ELSE 'atom' END AS method,
  s_suppkey % 2 = 0 AS has_token, s_suppkey % 11 <> 0 AS guarded FROM supplier),
reg AS (SELECT s_name AS source_id, CASE WHEN s_suppkey % 8 = 1 THEN 'rss' ELSE 'atom' END AS method, s_suppkey % 5 = 0 AS needs FROM supplier)"""
REPORTS = f"""rep AS (SELECT delivery_id, attempt_id, event_id, attempted_nano, status, CASE WHEN intermediate THEN (event_id % 2 + 1)::INTEGER ELSE 0 END AS sequence FROM attempts),
all_reps AS (SELECT * FROM rep UNION ALL SELECT delivery_id, attempt_id, event_id, attempted_nano + {AGAIN}, status, sequence FROM rep WHERE event_id % 5 = 0
  UNION ALL SELECT delivery_id + 1, attempt_id, event_id, attempted_nano + (event_id % 3 - 1) * {HALF_DAY}, status, sequence FROM rep WHERE event_id % 7 = 0),
num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY attempted_nano, event_id) AS nth, row_number() OVER (ORDER BY attempted_nano, event_id, attempt_id, delivery_id) AS place FROM all_reps),
own0 AS (SELECT attempt_id, delivery_id AS owner, place AS owned_at FROM num WHERE false)"""
#: All deliveries folded with the owners of ids that the fold before gave; the first fold knows none.
RUN = """num{k} AS MATERIALIZED (SELECT n.*, coalesce(o.owner <> n.delivery_id AND o.owned_at < n.place, false) AS theirs FROM num n LEFT JOIN own{k} o USING (attempt_id)),
run{k} AS (
  SELECT DISTINCT delivery_id, 0::BIGINT AS nth, 'due' AS status, 0 AS attempt, 0 AS confirmed_through, NULL::BIGINT AS next_attempt_nano, false AS inactive, 0 AS accepted, 0 AS duplicate, 0 AS terminal, 0 AS conflict,
    []::STRUCT(id VARCHAR, place BIGINT)[] AS ids FROM num
  UNION ALL
  SELECT r.delivery_id, n.nth,
    CASE WHEN NOT taken THEN r.status WHEN moved THEN 'due' WHEN n.status = 'blocked' THEN 'blocked' WHEN n.status = 'success' THEN 'sent' WHEN r.attempt + 1 < 3 THEN 'retry' ELSE 'failed' END,
    CASE WHEN taken AND NOT moved THEN r.attempt + 1 ELSE r.attempt END,
    CASE WHEN NOT taken THEN r.confirmed_through WHEN moved THEN n.sequence WHEN n.status = 'success' THEN 3 ELSE r.confirmed_through END,
    CASE WHEN NOT taken THEN r.next_attempt_nano WHEN NOT moved AND n.status = 'failed' AND r.attempt + 1 < 3 THEN n.attempted_nano + 900000000000 END,
    CASE WHEN taken AND n.status = 'blocked' THEN true ELSE r.inactive END,
    r.accepted + taken::INTEGER, r.duplicate + again::INTEGER, r.terminal + (NOT again AND NOT theirs AND ended)::INTEGER, r.conflict + (theirs OR (NOT again AND NOT ended AND NOT fits))::INTEGER,
    CASE WHEN taken THEN list_append(r.ids, {{'id': n.attempt_id, 'place': n.place}}) ELSE r.ids END
  FROM run{k} r JOIN num{k} n ON n.delivery_id = r.delivery_id AND n.nth = r.nth + 1,
  LATERAL (SELECT r.status IN ('sent', 'failed', 'blocked', 'suppressed') AS ended, n.sequence = 0 OR n.sequence = r.confirmed_through + 1 AS fits, n.status = 'success' AND n.sequence IN (1, 2) AS moved,
    len(list_filter(r.ids, lambda i: i.id = n.attempt_id)) > 0 AS again) x,
  LATERAL (SELECT NOT x.again AND NOT n.theirs AND NOT x.ended AND x.fits AS taken) y),
end{k} AS MATERIALIZED (SELECT * FROM run{k} QUALIFY row_number() OVER (PARTITION BY delivery_id ORDER BY nth DESC) = 1),
own{next} AS MATERIALIZED (SELECT i.id AS attempt_id, arg_min(delivery_id, i.place) AS owner, min(i.place) AS owned_at FROM (SELECT delivery_id, unnest(ids) AS i FROM end{k}) GROUP BY 1)"""
FOLDS = 5
OUTCOMES = ",\n".join([REPORTS, *[RUN.format(k=k, next=k + 1) for k in range(FOLDS)]])
PATCH = """pp AS (SELECT *, telegram_id % 3 <> 0 AS patched FROM preferences),
p AS (SELECT telegram_id, CASE WHEN patched AND telegram_id % 2 = 0 THEN 'EUROPE,ASIA' WHEN patched AND telegram_id % 5 = 0 THEN '' ELSE region END AS regions, category AS categories,
  CASE WHEN patched AND telegram_id % 4 = 1 THEN '07:30' ELSE delivery_time END AS delivery_time, CASE WHEN patched AND telegram_id % 7 = 1 THEN 'Mars/Base' ELSE timezone END AS timezone,
  CASE WHEN patched AND telegram_id % 6 = 1 THEN 7 ELSE max_items END AS max_items FROM pp)"""
BLOCK_ = """CASE signal_type WHEN 'launch' THEN 'запуск' WHEN 'news' THEN 'новость' WHEN 'funding' THEN 'финансирование' WHEN 'acquisition' THEN 'приобретение' WHEN 'award' THEN 'награда' WHEN 'ranking' THEN 'рейтинг' ELSE signal_type END"""
ROUND_ = "CASE f.round WHEN 'seed' THEN 'посевной раунд' WHEN 'series a' THEN 'раунд A' END"
REGION_ = "CASE region WHEN 'ASIA' THEN 'Азия' WHEN 'EUROPE' THEN 'Европа' ELSE region END"
FACTS_ = f"concat_ws(', ', {ROUND_}, CASE WHEN f.amount <> '' THEN f.amount || ' ' || f.currency END, CASE WHEN len(investors) > 0 THEN 'инвесторы: ' || array_to_string(investors, ', ') END)"
PAID_ = f"CASE WHEN {FACTS_} = '' THEN 'Зафиксирован новый раунд финансирования — у компании появились ресурсы для следующего этапа развития.' ELSE 'Компания привлекла финансирование (' || {FACTS_} || ') — это ресурс для следующего этапа развития.' END"
NKEYS_ = "len(list_distinct(list_transform(sources, lambda s: split_part(s, '@', 1))))"
ITEM_BLOCK = f"""concat_ws(chr(10), '1. <b>' || startup_name || '</b>',
  '📝 <b>Описание:</b> ' || CASE WHEN description <> '' THEN description ELSE 'Стартап: сфера — ' || array_to_string(categories, ', ') || '; регион — ' || {REGION_} || '.' END,
  '💡 <b>Почему интересно:</b> ' || concat_ws(' ', CASE signal_type WHEN 'launch' THEN 'Свежий запуск показывает, что продукт уже представлен рынку.' WHEN 'news' THEN 'О компании вышла свежая новость — можно проследить актуальное изменение в её развитии.'
    WHEN 'acquisition' THEN 'Зафиксировано приобретение компании — это существенное событие в развитии проекта.' WHEN 'award' THEN 'Компания получила награду — это внешний сигнал признания проекта.' WHEN 'ranking' THEN 'Компания вошла в отраслевой рейтинг — это внешний сигнал заметности проекта.' END,
    CASE WHEN signal_type = 'funding' OR f.amount <> '' OR f.round <> '' OR len(investors) > 0 THEN {PAID_} END,
    'Фокус проекта: ' || array_to_string(categories, ', ') || '.', 'Регион проекта: ' || {REGION_} || '.', CASE WHEN {NKEYS_} > 1 THEN 'Сигнал отмечен в ' || {NKEYS_} || ' независимых источниках.' END),
  '📣 Сигнал: ' || {BLOCK_}, '🌍 Регион: ' || {REGION_}, '🏷 Категории: ' || array_to_string(categories, ', '),
  CASE WHEN f.amount <> '' THEN '💰 Финансирование: ' || concat_ws(', ', {ROUND_}, f.amount || ' ' || f.currency) END, CASE WHEN len(investors) > 0 THEN '👥 Инвесторы: ' || array_to_string(investors, ', ') END,
  '🔗 Источники: ' || array_to_string(list_transform(sources, lambda s: '<a href="' || split_part(s, '@', 2) || '">' || split_part(s, '@', 1) || '</a>'), ', '))"""
ITEMS_ = digests.recursive(digests.chain(*digests.TO_ITEMS))
ORACLE_SQL = {
    "due_deliveries": f"{with_('deliveries', 'subscribers')} SELECT id, telegram_id, status, created_nano, next_attempt_nano FROM deliveries JOIN subscribers USING (telegram_id) WHERE active AND status IN ('due', 'retry') AND (next_attempt_nano IS NULL OR next_attempt_nano <= {DUE_NANO}) ORDER BY created_nano, id LIMIT 100",
    "pending_messages": f"{with_('deliveries')} SELECT id AS delivery_id, count(*) AS n, min(s)::INTEGER AS next FROM deliveries, (SELECT unnest([1, 2, 3]) AS s) WHERE s > confirmed_through GROUP BY id",
    "delivery_outcomes": digests.recursive(f"{with_('attempts')}, {OUTCOMES}") + f" SELECT delivery_id, status, attempt, confirmed_through, next_attempt_nano, inactive, accepted, duplicate, terminal, conflict FROM end{FOLDS - 1}",
    "suppressed_deliveries": f"""{with_('deliveries')}, it AS (SELECT 'del_' || l_orderkey AS id, l_partkey % 90 = 5 AS bare, 's' || (l_suppkey % 40) AS sid, l_suppkey % 40 % 9 = 4 OR l_suppkey % 50 = 7 AS bad FROM lineitem),
chk AS (SELECT id, bool_or(bare) AS any_bare, coalesce(list_sort(list(DISTINCT sid) FILTER (bad AND NOT bare)), []) AS off FROM it GROUP BY id),
d AS (SELECT d.*, CASE WHEN any_bare THEN [] ELSE off END AS off, split_part(d.id, '_', 2)::BIGINT % 7 = 0 AS stale FROM deliveries d JOIN chk USING (id) WHERE any_bare OR len(off) > 0),
a AS (SELECT *, CASE WHEN status NOT IN ('due', 'retry') THEN 'terminal' WHEN stale THEN 'conflict' ELSE 'applied' END AS answer FROM d)
SELECT id, CASE WHEN answer = 'applied' THEN 'suppressed' ELSE status END AS status, answer, CASE WHEN answer = 'applied' THEN array_to_string(off, ',') ELSE '' END AS sources, CASE WHEN answer = 'applied' THEN {DUE_NANO} END AS suppressed_nano FROM a""",
    "latest_delivery": f"{with_('deliveries')} SELECT telegram_id, id, status, created_nano FROM deliveries QUALIFY row_number() OVER (PARTITION BY telegram_id ORDER BY created_nano DESC, id DESC) = 1",
    "health_sources": f"{with_('health')} SELECT status, count(*) AS n, max(last_ingestion_nano) AS last_ingestion_nano FROM health GROUP BY status",
    "health_failures": f"""{with_('health', 'deliveries', 'attempts')}, l AS (SELECT 'del_' || delivery_id AS id, max(attempted_nano) AS last FROM attempts GROUP BY 1)
SELECT * FROM (SELECT last_ingestion_nano AS occurred_nano, 'source:' || source_id AS component, 'source is unhealthy' AS message FROM health WHERE status NOT IN ('ok', 'skipped')
UNION ALL SELECT greatest(created_nano, last), 'delivery:' || id, 'delivery is awaiting retry' FROM deliveries LEFT JOIN l USING (id) WHERE status = 'retry') ORDER BY occurred_nano DESC, component LIMIT 50""",
    "health_summary": f"""{with_('health', 'deliveries', 'attempts', 'subscribers')} SELECT (SELECT max(last_ingestion_nano) FROM health) AS last_ingestion_nano, (SELECT count(*) FROM subscribers WHERE active) AS active_subscribers,
(SELECT max(t) FROM (SELECT created_nano AS t FROM deliveries UNION ALL SELECT attempted_nano FROM attempts)) AS last_activity_nano,
EXISTS (SELECT 1 FROM health WHERE status NOT IN ('ok', 'skipped')) OR EXISTS (SELECT 1 FROM deliveries WHERE status IN ('retry', 'failed', 'blocked')) AS degraded""",
    "source_resolution": f"""WITH {CONFIG} SELECT c.source_id, CASE WHEN NOT active THEN 'skipped' WHEN r.source_id IS NULL OR c.method <> r.method OR (needs AND NOT has_token) THEN 'config_error' ELSE 'ready' END AS status,
CASE WHEN NOT active THEN 'inactive' WHEN r.source_id IS NULL THEN 'unknown source' WHEN c.method <> r.method THEN 'access method mismatch' WHEN needs AND NOT has_token THEN 'missing credentials' ELSE '' END AS detail FROM cfg c LEFT JOIN reg r USING (source_id)""",
    "cadence_due": f"{with_('health')}, {CONFIG} SELECT c.source_id, NOT guarded OR last_attempt_nano IS NULL OR {CADENCE_NANO} >= last_attempt_nano + 86400000000000 AS due FROM cfg c LEFT JOIN health h USING (source_id)",
    "overlay_problems": f"WITH {CONFIG} SELECT source_id, CASE WHEN r.source_id IS NULL THEN 'unknown' WHEN c.method <> r.method THEN 'mismatch' ELSE 'credentials' END AS problem FROM cfg c LEFT JOIN reg r USING (source_id) WHERE r.source_id IS NULL OR c.method <> r.method OR has_token",
    "preferences_patch": f"{with_('preferences')}, {PATCH} SELECT * FROM p",
    "preferences_valid": f"{with_('preferences')}, {PATCH} SELECT CASE WHEN timezone = 'Mars/Base' THEN 'timezone' WHEN max_items NOT BETWEEN 5 AND 10 THEN 'max_items' ELSE 'fine' END AS problem, CASE WHEN max_items <= 0 THEN 10 ELSE greatest(5, least(10, max_items)) END AS \"limit\", CASE WHEN max_items < 1 OR max_items > 10 THEN 10 WHEN max_items < 5 THEN 5 ELSE max_items END AS stored, count(*) AS n FROM p GROUP BY ALL",
    "preferences_text": f"""{with_('preferences')} SELECT telegram_id, replace(region, 'MIDDLE EAST', 'MIDDLE') || ',X' AS regions, delivery_time, CASE WHEN telegram_id % 4 = 0 THEN 'Nowhere' ELSE timezone END AS timezone, max_items,
concat_ws(',', CASE WHEN telegram_id % 5 = 0 THEN 'colour:unknown' END, CASE WHEN telegram_id % 4 = 0 THEN 'timezone:invalid' END, CASE WHEN max_items NOT BETWEEN 5 AND 10 THEN 'max:invalid' END) AS errors FROM preferences""",
    "upsert_signals": f"{with_('signals')} SELECT id, CASE WHEN published_nano % 2000000000 = 0 OR source_id = 'Brand#7' THEN upper(startup_name) ELSE startup_name END AS startup_name, source_id, published_nano FROM signals",
    "upsert_health": f"""{with_('health')}, h AS (SELECT *, split_part(source_id, '#', 2)::BIGINT AS k FROM health)
SELECT source_id, CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN 'ok' ELSE status END AS status, last_ingestion_nano,
CASE WHEN (k % 2 = 0 OR k % 3 = 0) AND last_attempt_nano % 7000000000 = 0 THEN last_attempt_nano + 5 WHEN k % 3 <> 0 THEN last_attempt_nano END AS last_attempt_nano FROM h""",
    "upsert_deliveries": f"""{with_('deliveries')}, d AS (SELECT *, split_part(id, '_', 2)::BIGINT % 4 = 0 AS absent, split_part(id, '_', 2)::BIGINT % 3 = 0 AS replayed FROM deliveries)
SELECT id, CASE WHEN absent OR (replayed AND status <> 'sent') THEN 'retry' ELSE status END AS status, CASE WHEN absent OR (replayed AND status <> 'sent') THEN 2 ELSE attempt END AS attempt,
CASE WHEN absent THEN 0 ELSE confirmed_through END AS confirmed_through, CASE WHEN absent THEN created_nano + 1 ELSE created_nano END AS created_nano FROM d""",
    "render_items": f"{ITEMS_} SELECT window_id, identity, {ITEM_BLOCK} AS block FROM items",
    "translate_terms": f"""{with_('signals')} SELECT r_name AS term, CASE r_name WHEN 'ASIA' THEN 'Азия' WHEN 'EUROPE' THEN 'Европа' ELSE r_name END AS shown FROM region
UNION ALL VALUES ('series b', 'раунд B'), ('Series  Z', 'раунд Z'), (' seed ', 'посевной раунд'), ('series aa', 'series aa'), ('Bridge', 'Bridge')
UNION ALL SELECT signal_type, {BLOCK_} FROM (SELECT DISTINCT signal_type FROM signals)""",
}
