"""From signals to personal digests.

What a digest may hold depends on the local day alone, and how it is ranked on few preferences. So candidates are built
once for each window (time zone and date), ranked once for each distinct set of preferences in a window, and only the
chosen few items are joined to subscribers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import identity as ids
from millrace.functions import scoring, times
from millrace.operators import grouping, selection
from millrace.plans import derive
from millrace.plans.derive import NOW, NOW_NANO, with_
from millrace.session import staged


RECENT = "2001-06-01"


def windows(preferences: DataFrame, now: str = NOW) -> DataFrame:
    """One row per time zone in use: window_id, digest_date, [from_nano, until_nano). There are as many as zones."""
    zones = preferences.select("timezone").distinct()
    begins, ends = times.day_window(now, F.col("timezone"))
    date = times.local_date(now, F.col("timezone"))
    return zones.select("timezone", date.alias("digest_date"), F.concat_ws("|", "timezone", date).alias("window_id"), begins.alias("from_nano"), ends.alias("until_nano"))


def in_windows(signals: DataFrame, windows_: DataFrame) -> DataFrame:
    """Signals of each window: an equality on the UTC days that a window touches, then its bounds."""
    day = lambda nano: times.whole(nano, times.DAY)
    touched = windows_.withColumn("utc_day", F.explode(F.sequence(day(F.col("from_nano")), day(F.col("until_nano") - 1))))
    # a few rows for each zone there is: signals stay where they are, rather than in a task for each day
    rows = signals.withColumn("utc_day", day(F.col("published_nano"))).join(F.broadcast(touched), "utc_day")
    return rows.where((F.col("published_nano") >= F.col("from_nano")) & (F.col("published_nano") < F.col("until_nano"))).drop("utc_day", "from_nano", "until_nano")


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that may be shown."""
    return derive.table(spark, sf_dir, "part").select(F.col("p_brand").alias("source_id")).distinct().where("CAST(substring_index(source_id, '#', -1) AS INT) % 6 <> 0")


def eligible(signals: DataFrame, policy_: DataFrame) -> DataFrame:
    return signals.join(policy_, "source_id", "left_semi")


def window_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible(in_windows(derive.signals(spark, sf_dir), windows(derive.preferences(spark, sf_dir))), policy(spark, sf_dir))


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of all windows with their keys, written once: grouping reads them several times."""
    return staged(grouping.identified(window_signals(spark, sf_dir)))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.merged(grouping.grouped(identified(spark, sf_dir)))


def plan_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active subscribers with preferences, whether their run is due, their date, limit and window."""
    rows = derive.subscribers(spark, sf_dir).where("active").join(derive.preferences(spark, sf_dir), "telegram_id", "left")
    known = F.col("timezone").isin(*derive.ZONES) & times.valid_clock(F.col("delivery_time"))
    zone = F.when(known, F.col("timezone"))
    rows = rows.withColumns({"zone": zone, "due": F.when(known, times.schedule_due(NOW, NOW_NANO, zone, F.col("delivery_time"))), "digest_date": times.local_date(NOW, zone)})
    return rows.withColumns({"limit": scoring.item_limit(F.col("max_items")), "window_id": F.concat_ws("|", "zone", "digest_date")})


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that are queued already: those of the latest orders, moved to their subscriber's date."""
    old = derive.deliveries(spark, sf_dir).where(F.col("digest_date") >= RECENT).select("telegram_id").distinct()
    return old.join(plan_subscribers(spark, sf_dir), "telegram_id").select("telegram_id", "digest_date")


def open_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_subscribers(spark, sf_dir).where("due").join(existing(spark, sf_dir), ["telegram_id", "digest_date"], "left_anti")


def with_base(items: DataFrame) -> DataFrame:
    """Items with `score`, the part of it that is the same for all."""
    return items.withColumn("score", scoring.base_score(F.col("signal_type"), F.col("funding"), F.col("sources"), F.col("published_nano").isNotNull(), derive.priority))


def scored(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """Items with `kind`, in each profile of their window, with the profile's score."""
    rows = items.join(selection.kind_scores(items, profiles), ["window_id", "kind"])
    return rows.withColumn("score", F.col("score") + F.col("bonus")).drop("kind", "bonus")


def profiles(subscribers: DataFrame) -> DataFrame:
    return subscribers.select("window_id", F.col("regions").alias("liked_regions"), F.col("categories").alias("liked_categories")).distinct()


PROFILE = ["window_id", "liked_regions", "liked_categories"]


def digest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen items of each due subscriber's digest."""
    people = open_subscribers(spark, sf_dir)
    likes = staged(profiles(people))
    items = staged(with_base(candidates(spark, sf_dir)))
    counts = items.groupBy("window_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    # the most that any limit takes, by keys alone; a lower limit takes the first by choice
    able = staged(selection.contenders(selection.with_kinds(items, likes)))
    slim = selection.with_one_each(able.select("window_id", "identity", "kind", "score", "published_nano", "startup_name", "sources"))
    best = selection.balanced(scored(slim, likes), *PROFILE)
    # place is that of a profile under a limit: worked out before subscribers, of whom there are many more, join
    mine = F.row_number().over(selection.Window.partitionBy(*PROFILE, "limit").orderBy("key"))
    taken = best.withColumn("limit", F.explode(F.sequence(F.col("choice"), F.lit(selection.MOST)))).withColumn("place", mine)
    taken = staged(taken.join(counts, "window_id").select(*PROFILE, "limit", "identity", "score", "place", "candidate_count"))
    rows = people.select("telegram_id", "digest_date", "limit", "window_id", F.col("regions").alias("liked_regions"), F.col("categories").alias("liked_categories")).join(taken, [*PROFILE, "limit"]).drop(*PROFILE[1:], "limit")
    # whatever is chosen is among the contenders. Texts are as long as all sources of an item: they come last, so that they are not
    # moved for each subscriber, and by shuffles, as their file is many times smaller than they are
    texts = able.drop("published_nano", "score", "kind").join(taken.select("window_id", "identity").distinct(), ["window_id", "identity"], "left_semi")
    rows = rows.join(texts.hint("shuffle_hash"), ["window_id", "identity"])
    digest = ids.digest_id(F.col("telegram_id"), F.col("digest_date"))
    rows = rows.withColumn("digest_id", digest)
    return rows.select(
        "telegram_id",
        "digest_id",
        ids.item_id(F.col("digest_id"), F.col("place")).alias("item_id"),
        "digest_date",
        F.col("place").cast("int").alias("place"),
        "candidate_count",
        F.col("identity").alias("candidate_identity"),
        "startup_name",
        "signal_type",
        "region",
        F.col("score").cast("int").alias("score"),
        F.array_join("categories", ",").alias("categories"),
        F.concat_ws("/", "funding.round", "funding.amount", "funding.currency", F.array_join("funding.investors", ",")).alias("funding"),
        F.array_join(F.transform("sources", lambda s: F.concat_ws("@", s["source_id"], s["source_url"])), ",").alias("sources"),
    )


# SQL of the same steps, for DuckDB.
ZONES_SQL = f"""zones AS (SELECT DISTINCT timezone, strftime(TIMESTAMPTZ '{NOW}+00' AT TIME ZONE timezone, '%Y-%m-%d') AS digest_date FROM preferences),
windows AS (SELECT timezone, digest_date, timezone || '|' || digest_date AS window_id,
  epoch_us(digest_date::TIMESTAMP AT TIME ZONE timezone) * 1000 AS from_nano,
  epoch_us((digest_date::TIMESTAMP + INTERVAL 1 DAY) AT TIME ZONE timezone) * 1000 AS until_nano FROM zones)"""
POLICY_SQL = "policy AS (SELECT DISTINCT p_brand AS source_id FROM part WHERE split_part(p_brand, '#', 2)::INTEGER % 6 <> 0)"
TOKEN = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{Nd}}]+', '-', 'g'), '-')"
SUFFIX = r"regexp_replace({0}, '-(company|corp|corporation|gmbh|inc|incorporated|limited|llc|ltd|plc)$', '')"
IDENT_SQL = f"""ws AS (SELECT s.*, w.window_id, w.digest_date FROM signals s JOIN windows w ON s.published_nano >= w.from_nano AND s.published_nano < w.until_nano
  WHERE s.source_id IN (SELECT source_id FROM policy)),
tok AS (SELECT *, {TOKEN.format("startup_name")} AS exact_t, {SUFFIX.format(TOKEN.format("startup_name"))} AS suffix_t, {TOKEN.format("region")} AS region_t FROM ws),
ident AS (SELECT *, CASE WHEN canonical_url <> '' THEN 'url:' || canonical_url ELSE '' END AS k_url,
  CASE WHEN length(replace(exact_t, '-', '')) >= 4 THEN 'exact:' || exact_t || ':' || region_t || ':' || digest_date ELSE '' END AS k_exact,
  CASE WHEN suffix_t <> exact_t AND length(replace(suffix_t, '-', '')) >= 4 THEN 'suffix:' || suffix_t || ':' || region_t || ':' || digest_date ELSE '' END AS k_suffix,
  CASE WHEN amount <> '' AND currency <> '' THEN replace(lower(amount), ' ', '-') || ':' || currency ELSE '' END AS k_funding FROM tok)"""
REACH_SQL = """akeys AS (
  SELECT window_id, id, k_exact AS k FROM ident WHERE k_exact <> ''
  UNION SELECT window_id, id, k_suffix || ':event:' || source_url FROM ident WHERE k_suffix <> ''
  UNION SELECT window_id, id, k_suffix || ':funding:' || k_funding FROM ident WHERE k_suffix <> '' AND k_funding <> ''),
step AS (SELECT DISTINCT a.window_id, a.id, b.low FROM akeys a JOIN (SELECT window_id, k, min(id) AS low FROM akeys GROUP BY ALL) b USING (window_id, k)),
both_ways AS (SELECT window_id, id AS x, low AS y FROM step UNION SELECT window_id, low, id FROM step),
reach AS (SELECT window_id, x, x AS low FROM both_ways UNION SELECT b.window_id, b.x, r.low FROM reach r JOIN both_ways b ON b.window_id = r.window_id AND b.y = r.x WHERE r.low < b.x),
comp AS (SELECT window_id, x AS id, min(low) AS component FROM reach GROUP BY ALL)"""
GROUP_SQL = """anchored AS (SELECT i.*, coalesce(c.component, i.id) AS component FROM ident i LEFT JOIN comp c USING (window_id, id)),
anchors AS (SELECT window_id, component, count(DISTINCT nullif(k_url, '')) AS n, min(nullif(k_url, '')) AS url FROM anchored GROUP BY ALL),
grp AS (SELECT a.*, CASE WHEN k_url <> '' THEN k_url WHEN n = 0 THEN 'component:' || a.component WHEN n = 1 THEN url ELSE 'row:' || id END AS group_key
  FROM anchored a JOIN anchors USING (window_id, component))"""
COMPLETE = "(CASE WHEN {0}.amount <> '' AND {0}.currency <> '' THEN 2 ELSE 0 END + CASE WHEN {0}.round <> '' THEN 1 ELSE 0 END)"
AGREE = "(NOT (a.amount <> '' AND b.amount <> '' AND (lower(a.amount) <> lower(b.amount) OR lower(a.currency) <> lower(b.currency))) AND NOT (a.round <> '' AND b.round <> '' AND lower(a.round) <> lower(b.round)))"
FOLD = f"""list_reduce(list_transform(list(struct_pack(round := round, amount := amount, currency := currency, investors := CASE WHEN investor = '' THEN []::VARCHAR[] ELSE [investor] END) ORDER BY published_nano DESC, id),
    lambda f: f), lambda a, b: CASE WHEN {COMPLETE.format("b")} > {COMPLETE.format("a")}
      THEN struct_pack(round := b.round, amount := b.amount, currency := b.currency, investors := CASE WHEN {AGREE} THEN list_concat(b.investors, a.investors) ELSE b.investors END)
      ELSE struct_pack(round := a.round, amount := a.amount, currency := a.currency, investors := CASE WHEN {AGREE} THEN list_concat(a.investors, b.investors) ELSE a.investors END) END,
    struct_pack(round := '', amount := '', currency := '', investors := []::VARCHAR[]))"""
ITEM_SQL = f"""weighted AS (SELECT *, CASE signal_type WHEN 'funding' THEN 40 WHEN 'launch' THEN 30 WHEN 'award' THEN 25 WHEN 'acquisition' THEN 20 WHEN 'ranking' THEN 20 WHEN 'news' THEN 10 ELSE 5 END AS w FROM grp),
item0 AS (SELECT window_id, group_key, count(*) AS n_signals, min(id) AS member,
  coalesce(min(nullif(k_url, '')), min(nullif(k_exact, '')), min(nullif(k_suffix, '')), 'signal:' || min(id)) AS base,
  coalesce(first(startup_name ORDER BY published_nano DESC, id) FILTER (startup_name <> ''), '') AS startup_name,
  coalesce(first(description ORDER BY published_nano DESC, id) FILTER (description <> ''), '') AS description,
  coalesce(first(region ORDER BY published_nano DESC, id) FILTER (region <> ''), '') AS region,
  first(signal_type ORDER BY w DESC, published_nano DESC, id) AS signal_type, max(w) AS w, max(published_nano) AS published_nano,
  list_sort(list(DISTINCT category)) AS categories, {FOLD} AS f, list_transform(list_sort(list(DISTINCT struct_pack(a := source_id, b := source_url))), lambda s: s.a || '@' || s.b) AS sources
  FROM weighted GROUP BY window_id, group_key),
items AS (SELECT *, base || '|member:' || member AS identity, list_sort(list_distinct(f.investors)) AS investors FROM item0)"""
PEOPLE_SQL = f"""people AS (SELECT s.telegram_id, p.region AS liked_region, p.category AS liked_category, p.timezone, p.delivery_time, p.max_items,
  strftime(TIMESTAMPTZ '{NOW}+00' AT TIME ZONE p.timezone, '%Y-%m-%d') AS digest_date,
  TIMESTAMPTZ '{NOW}+00' >= ((strftime(TIMESTAMPTZ '{NOW}+00' AT TIME ZONE p.timezone, '%Y-%m-%d') || ' ' || p.delivery_time || ':00')::TIMESTAMP AT TIME ZONE p.timezone) AS due,
  CASE WHEN p.max_items <= 0 THEN 10 ELSE greatest(5, least(10, p.max_items)) END AS lim
  FROM subscribers s JOIN preferences p USING (telegram_id) WHERE s.active),
existing AS (SELECT DISTINCT d.telegram_id FROM deliveries d JOIN people USING (telegram_id) WHERE d.digest_date >= '{RECENT}'),
open_people AS (SELECT *, timezone || '|' || digest_date AS window_id FROM people WHERE due AND telegram_id NOT IN (SELECT telegram_id FROM existing))"""
SCORE_SQL = """scored AS (SELECT o.telegram_id, o.digest_date, o.lim, i.*,
  i.w + CASE WHEN f.amount <> '' THEN 30 ELSE 0 END + CASE WHEN f.round <> '' THEN 10 ELSE 0 END + CASE WHEN len(investors) > 0 THEN 10 ELSE 0 END
  + len(sources) * 5 + list_sum(list_transform(sources, lambda s: (split_part(split_part(s, '@', 1), '#', 2)::INTEGER % 5 - 1) * 3))::INTEGER + 10 + 25 * len(list_filter(categories, lambda c: c = o.liked_category)) + CASE WHEN i.region = o.liked_region THEN 25 ELSE 0 END AS score
  FROM open_people o JOIN items i USING (window_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY telegram_id ORDER BY score DESC, published_nano DESC, lower(startup_name), identity) AS rank FROM scored)"""
CHOICE_SQL = """skeys AS (SELECT DISTINCT telegram_id, rank, split_part(s, '@', 1) AS sk FROM (SELECT telegram_id, rank, unnest(sources) AS s FROM ranked)),
firsts AS (SELECT DISTINCT telegram_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY telegram_id, sk ORDER BY rank) AS nth FROM skeys) WHERE nth <= 2),
choices AS (SELECT r.*, row_number() OVER (PARTITION BY r.telegram_id ORDER BY (f.rank IS NULL), r.rank) AS choice FROM ranked r LEFT JOIN firsts f ON f.telegram_id = r.telegram_id AND f.rank = r.rank),
placed AS (SELECT *, row_number() OVER (PARTITION BY telegram_id ORDER BY rank) AS place FROM choices WHERE choice <= lim)"""


def chain(*names: str) -> str:
    """The beginning of a statement up to and with a step."""
    return f"{with_('subscribers', 'preferences', 'signals', 'deliveries')},\n" + ",\n".join(names)


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


TO_GROUPS = (ZONES_SQL, POLICY_SQL, IDENT_SQL, REACH_SQL, GROUP_SQL)
TO_ITEMS = (*TO_GROUPS, ITEM_SQL)
TO_PLACES = (*TO_ITEMS, PEOPLE_SQL, SCORE_SQL, CHOICE_SQL)


def signals_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_windows(derive.signals(spark, sf_dir), windows(derive.preferences(spark, sf_dir)))
    return rows.select("window_id", "id", "published_nano")


def local_day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows at several times, days of 23 and 25 hours among them."""
    prefs = derive.preferences(spark, sf_dir)
    out = None
    for now in (NOW, "2024-03-31 12:00:00", "2024-10-27 12:00:00", "2024-11-03 18:00:00"):
        rows = windows(prefs, now).select("timezone", "digest_date", "from_nano", "until_nano", ((F.col("until_nano") - F.col("from_nano")) / F.lit(3600 * 10**9)).cast("int").alias("hours"))
        out = rows if out is None else out.unionByName(rows)
    return out


def eligible_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eligible(derive.signals(spark, sf_dir), policy(spark, sf_dir))
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.alias_components(identified(spark, sf_dir))


def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.grouped(identified(spark, sf_dir)).select("window_id", "id", "group_key")


def merged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("window_id", "identity", "n_signals", "startup_name", "description", "region", "signal_type", "published_nano", F.array_join("categories", ",").alias("categories"), F.array_join(F.transform("sources", lambda s: F.concat_ws("@", s["source_id"], s["source_url"])), ",").alias("sources"))


def merged_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("window_id", "identity", F.col("funding.round").alias("round"), F.col("funding.amount").alias("amount"), F.col("funding.currency").alias("currency"), F.array_join("funding.investors", ",").alias("investors"))


def item_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("window_id", "group_key", "identity")


def ordered_items(spark: SparkSession, sf_dir: str, *carry: str) -> tuple[DataFrame, DataFrame]:
    """(profiles by number, items of all windows in order, with the columns to carry)."""
    likes = staged(profiles(open_subscribers(spark, sf_dir)).withColumn("profile", F.monotonically_increasing_id()))
    items = selection.with_kinds(selection.with_one_each(with_base(candidates(spark, sf_dir))), likes)
    order = ["window_id", "kind", "score", "published_nano", "startup_name", "identity"]
    items = staged(items.select(*order, *[c for c in carry if c not in order]))
    pieces = max(items.count() // selection.PIECE, 4 * spark.sparkContext.defaultParallelism)
    return likes, selection.in_order(items, pieces, *carry)


LIKED = ["array_join(liked_regions, ',') AS liked_region", "array_join(liked_categories, ',') AS liked_category"]


def ranked_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    likes, items = ordered_items(spark, sf_dir, "identity")
    rows = selection.ranks(items, likes, "identity").join(likes, "profile")
    return rows.select("window_id", *map(F.expr, LIKED), F.col("rank").cast("int").alias("rank"), "identity", F.col("score").cast("int").alias("score"))


def selected_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    likes, items = ordered_items(spark, sf_dir, "identity", "published_nano", "startup_name", "sources")
    able = selection.contenders(items).select("tie", F.col("sources").alias("able"))
    marked = staged(items.drop("published_nano", "startup_name", "sources").join(able, "tie", "left"))
    keys = staged(selection.ranks(marked, likes, "identity", "able").where("able IS NOT NULL").select("profile", "rank", "identity", F.col("able").alias("sources")))
    rows = selection.chosen(keys, "profile", limit=F.lit(7)).join(likes, "profile")
    return rows.select("window_id", *map(F.expr, LIKED), F.col("rank").cast("int").alias("rank"), F.col("place").cast("int").alias("place"), "identity")


def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).groupBy("window_id").agg(F.count(F.lit(1)).alias("candidate_count"), F.sum("n_signals").alias("n_signals"))


def group_by_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouping.identified(window_signals(spark, sf_dir)).where(F.col("identity.url") != "")
    return rows.groupBy("window_id", F.col("identity.url").alias("url")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def delivery_queue_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = open_subscribers(spark, sf_dir)
    return rows.select(
        ids.delivery_id(F.col("telegram_id"), F.col("digest_date")).alias("id"), "telegram_id", ids.digest_id(F.col("telegram_id"), F.col("digest_date")).alias("digest_id"),
        "digest_date", F.lit("due").alias("status"), F.lit(0).alias("attempt"), F.lit(NOW_NANO).alias("created_nano"),
    )


def cycle_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many subscribers a planning cycle queues, and why it does not queue the others."""
    rows = plan_subscribers(spark, sf_dir).join(existing(spark, sf_dir).withColumn("queued", F.lit(True)), ["telegram_id", "digest_date"], "left")
    outcome = F.when(F.col("zone").isNull(), "failed").when(~F.col("due"), "not_due").when(F.col("queued"), "already_queued").otherwise("queued")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("subscribers"))


PROFILE_SQL = """profiles AS (SELECT DISTINCT window_id, liked_region, liked_category FROM open_people),
pscored AS (SELECT p.liked_region, p.liked_category, i.*,
  i.w + CASE WHEN f.amount <> '' THEN 30 ELSE 0 END + CASE WHEN f.round <> '' THEN 10 ELSE 0 END + CASE WHEN len(investors) > 0 THEN 10 ELSE 0 END
  + len(sources) * 5 + list_sum(list_transform(sources, lambda s: (split_part(split_part(s, '@', 1), '#', 2)::INTEGER % 5 - 1) * 3))::INTEGER + 10 + 25 * len(list_filter(categories, lambda c: c = p.liked_category)) + CASE WHEN i.region = p.liked_region THEN 25 ELSE 0 END AS score
  FROM profiles p JOIN items i USING (window_id)),
pranked AS (SELECT *, window_id || liked_region || liked_category AS pid, row_number() OVER (PARTITION BY window_id, liked_region, liked_category ORDER BY score DESC, published_nano DESC, lower(startup_name), identity)::INTEGER AS rank FROM pscored)"""
PCHOICE_SQL = """pkeys AS (SELECT DISTINCT pid, rank, split_part(s, '@', 1) AS sk FROM (SELECT pid, rank, unnest(sources) AS s FROM pranked)),
pfirst AS (SELECT DISTINCT pid, rank FROM (SELECT *, row_number() OVER (PARTITION BY pid, sk ORDER BY rank) AS nth FROM pkeys) WHERE nth <= 2),
pchoice AS (SELECT r.*, row_number() OVER (PARTITION BY r.pid ORDER BY (f.rank IS NULL), r.rank) AS choice FROM pranked r LEFT JOIN pfirst f ON f.pid = r.pid AND f.rank = r.rank)"""
HOURS = "UNION ALL ".join(
    f"""SELECT timezone, d AS digest_date, epoch_us(d::TIMESTAMP AT TIME ZONE timezone) * 1000 AS from_nano, epoch_us((d::TIMESTAMP + INTERVAL 1 DAY) AT TIME ZONE timezone) * 1000 AS until_nano
 FROM (SELECT DISTINCT timezone, strftime(TIMESTAMPTZ '{now}+00' AT TIME ZONE timezone, '%Y-%m-%d') AS d FROM preferences) """
    for now in (NOW, "2024-03-31 12:00:00", "2024-10-27 12:00:00", "2024-11-03 18:00:00")
)

QUERIES = {
    "digest_items": digest_items,
    "signals_window": signals_window,
    "local_day_windows": local_day_windows,
    "eligible_signals": eligible_signals,
    "group_by_canonical": group_by_canonical,
    "alias_components": alias_components,
    "entity_groups": entity_groups,
    "merged_items": merged_items,
    "merged_funding": merged_funding,
    "item_identity": item_identity,
    "score_rank_items": ranked_profiles,
    "select_source_aware": selected_profiles,
    "digest_candidate_counts": candidate_counts,
    "delivery_queue_new": delivery_queue_new,
    "cycle_outcomes": cycle_outcomes,
}

ORACLE_SQL = {
    "digest_items": recursive(chain(*TO_PLACES)) + ", o AS (SELECT *, 'dig_' || sha256(telegram_id || ':' || digest_date)[:24] AS digest_id FROM placed)" + """
SELECT telegram_id, digest_id, 'item_' || sha256(digest_id || ':' || place)[:24] AS item_id, digest_date, place::INTEGER AS place,
  (SELECT count(*) FROM items i WHERE i.window_id = o.window_id) AS candidate_count, identity AS candidate_identity, startup_name, signal_type, region, score::INTEGER AS score,
  array_to_string(categories, ',') AS categories, f.round || '/' || f.amount || '/' || f.currency || '/' || array_to_string(investors, ',') AS funding, array_to_string(sources, ',') AS sources FROM o""",
    "signals_window": chain(ZONES_SQL) + " SELECT window_id, id, published_nano FROM signals JOIN windows ON published_nano >= from_nano AND published_nano < until_nano",
    "local_day_windows": f"{with_('preferences')}, h AS ({HOURS}) SELECT *, ((until_nano - from_nano) // 3600000000000)::INTEGER AS hours FROM h",
    "eligible_signals": chain(POLICY_SQL) + " SELECT source_id, count(*) AS n, min(id) AS first_id FROM signals WHERE source_id IN (SELECT source_id FROM policy) GROUP BY source_id",
    "group_by_canonical": chain(ZONES_SQL, POLICY_SQL, IDENT_SQL) + " SELECT window_id, k_url AS url, count(*) AS n, min(id) AS first_id FROM ident WHERE k_url <> '' GROUP BY ALL",
    "alias_components": recursive(chain(ZONES_SQL, POLICY_SQL, IDENT_SQL, REACH_SQL)) + " SELECT window_id, id, coalesce(component, id) AS component FROM ident LEFT JOIN comp USING (window_id, id)",
    "entity_groups": recursive(chain(*TO_GROUPS)) + " SELECT window_id, id, group_key FROM grp",
    "merged_items": recursive(chain(*TO_ITEMS)) + " SELECT window_id, identity, n_signals, startup_name, description, region, signal_type, published_nano, array_to_string(categories, ',') AS categories, array_to_string(sources, ',') AS sources FROM items",
    "merged_funding": recursive(chain(*TO_ITEMS)) + " SELECT window_id, identity, f.round AS round, f.amount AS amount, f.currency AS currency, array_to_string(investors, ',') AS investors FROM items",
    "item_identity": recursive(chain(*TO_ITEMS)) + " SELECT window_id, group_key, identity FROM items",
    "score_rank_items": recursive(chain(*TO_ITEMS, PEOPLE_SQL, PROFILE_SQL)) + " SELECT window_id, liked_region, liked_category, rank, identity, score::INTEGER AS score FROM pranked",
    "select_source_aware": recursive(chain(*TO_ITEMS, PEOPLE_SQL, PROFILE_SQL, PCHOICE_SQL)) + " SELECT window_id, liked_region, liked_category, rank, row_number() OVER (PARTITION BY pid ORDER BY rank)::INTEGER AS place, identity FROM pchoice WHERE choice <= 7",
    "digest_candidate_counts": recursive(chain(*TO_ITEMS)) + " SELECT window_id, count(*) AS candidate_count, sum(n_signals)::BIGINT AS n_signals FROM items GROUP BY window_id",
    "delivery_queue_new": chain(PEOPLE_SQL) + f" SELECT 'del_' || sha1(telegram_id || ':' || digest_date)[:24] AS id, telegram_id, 'dig_' || sha256(telegram_id || ':' || digest_date)[:24] AS digest_id, digest_date, 'due' AS status, 0 AS attempt, {NOW_NANO} AS created_nano FROM open_people",
    "cycle_outcomes": chain(PEOPLE_SQL) + " SELECT CASE WHEN NOT due THEN 'not_due' WHEN telegram_id IN (SELECT telegram_id FROM existing) THEN 'already_queued' ELSE 'queued' END AS outcome, count(*) AS subscribers FROM people GROUP BY 1",
}
