"""URL filters by a temporal list join.

A list is a log of dated changes (a pattern was added to or removed from a block or an allow list). Changes become
validity intervals; every capture is then joined as of its fetch time with the entries that were active. A pattern is a
host or domain, alone or with the beginning of a path; a capture is looked up under its host or parent domain and the
beginning of its path in each shape, a number of labels and of segments, that a pattern of the list has, so the join is
an equality on these keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import dropped, staged, table

SALTS = 16
#: Shapes that the patterns of a list may have: each is a key that every capture is looked up under.
SHAPES = 1024
URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)(?::[0-9]*)?(/[^?#]*)?"


def host_of(url: Column) -> Column:
    return F.lower(F.rtrim(F.regexp_extract(url, URL, 1), F.lit(".")))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, URL, 2)


def intervals(changes: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) of a log (pattern, action, at, change); valid_to is null while active.

    An `add` holds until the next change of the same pattern and action. Of changes at the same time the last in order
    of name counts (remove after add), and repeated ones count once; a `remove` without an `add` has no effect. Changes
    without pattern, action, time or kind are ignored.
    """
    log = changes.select("pattern", "action", "at", "change").dropna().groupBy("pattern", "action", "at").agg(F.max("change").alias("change"))
    order = Window.partitionBy("pattern", "action").orderBy("at")
    return log.withColumn("valid_to", F.lead("at").over(order)).where("change = 'add'").select("pattern", "action", F.col("at").alias("valid_from"), "valid_to")


def normal_pattern(pattern: Column) -> Column:
    """A pattern as captures are looked up: the host in lower case without scheme, user, port and final dot, and the path's
    segments without empty ones, so that slashes at the end or repeated do not matter. Null where no host is left."""
    bare = F.regexp_replace(F.trim(pattern), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//", "")
    place = F.regexp_replace(F.regexp_extract(bare, "^([^/?#]*)", 1), "^.*@", "")
    host = F.lower(F.rtrim(F.regexp_replace(place, r":[0-9]*$", ""), F.lit(".")))
    path = F.filter(F.split(F.regexp_extract(bare, "^[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    return F.when(host != "", F.array_join(F.concat(F.array(host), path), "/"))


def shapes_of(log: DataFrame) -> Column:
    """The numbers of labels and of path segments that the patterns of a log have, each pair once. A list with more than
    SHAPES of them is refused: captures are looked up under all."""
    parts = F.split("pattern", "/")
    shapes = log.where("change = 'add'").select(F.size(F.split(parts[0], r"\.")).alias("labels"), (F.size(parts) - 1).alias("depth")).distinct().limit(SHAPES + 1).collect()
    if len(shapes) > SHAPES:
        raise ValueError(f"the patterns have more than {SHAPES} shapes")
    none = F.array().cast("array<struct<labels:int,depth:int>>")
    return F.array(*[F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r["depth"]).alias("depth")) for r in sorted(shapes)]) if shapes else none


def keys_of(host: Column, path: Column, shapes: Column) -> Column:
    """All patterns of these shapes that match: the host or a parent, alone or with the beginning of the path."""
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    fitting = F.filter(shapes, lambda s: (s["labels"] <= F.size(labels)) & (s["depth"] <= F.size(parts)))
    domain = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    return F.transform(fitting, lambda s: F.array_join(F.concat(F.array(domain(s["labels"])), F.slice(parts, 1, s["depth"])), "/"))


def filtered(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per row of captures: id, url, fetched_at, host, decision, pattern, valid_from.

    decision is the action of the longest active pattern, at equal length of the one added last, then `block` before
    `allow`; `pass` where none is active; `invalid` where the url is null or has no host. A capture without a time is
    matched by nothing. Patterns count in normal form (normal_pattern), and are shown in it; changes of patterns that are
    the same in it are one log, and a pattern without a host is ignored. Equal captures give equal rows. Other columns are not read. Empty tables give empty ones, or
    pass all. The entries are written first, so that Spark knows their size: a list that is small enough goes to the
    captures, for a larger one both are dealt out by pattern, captures of one host spread over SALTS keys.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at"))
    host = F.when(host_of(F.col("url")) != "", host_of(F.col("url")))
    rows = rows.withColumns({"host": host, "path": F.coalesce(path_of(F.col("url")), F.lit(""))})
    log = staged(changes.select(normal_pattern(F.col("pattern")).alias("pattern"), "action", "at", "change").dropna())
    keys = F.when(F.col("host").isNotNull() & F.col("at").isNotNull(), keys_of(F.col("host"), F.col("path"), shapes_of(log)))
    rows = rows.select("id", "url", "at", "host", F.pmod(F.xxhash64("id", "url", "at"), F.lit(SALTS)).cast("int").alias("salt"), F.posexplode_outer(keys).alias("k", "pattern"))
    entries = staged(intervals(log)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dropped(log)
    active = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    found = rows.join(entries, ["pattern", "salt"], "left")
    match = F.when(active, F.struct(F.char_length("pattern").alias("length"), "valid_from", (F.col("action") == "block").alias("first"), "pattern", "action"))
    # a capture counts once for its first key, however many entries that key has: rows of one key and entry differ by it
    best = found.groupBy("id", "url", "at", "host").agg(F.max(match).alias("m"))
    times = rows.where(F.coalesce(F.col("k"), F.lit(0)) == 0).groupBy("id", "url", "at").agg(F.count(F.lit(1)).cast("int").alias("n"))
    repeated = times.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in ("id", "url", "at")], "n")
    same = F.lit(True)
    for c in ("id", "url", "at"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    best = best.join(repeated, same, "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)))))
    decision = F.when(F.col("host").isNull(), "invalid").otherwise(F.coalesce("m.action", F.lit("pass")))
    return best.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(time_col), "host", decision.alias("decision"), F.col("m.pattern").alias("pattern"), F.col("m.valid_from").alias("valid_from"))


def demo_captures(pages: DataFrame) -> DataFrame:
    """pages with a fetch time: the tables have none, so it is derived from the identifier."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") % 400 * 86_400 + F.col("page_id") % 86_400)
    return pages.select("page_id", "url", at.alias("fetched_at"))


def demo_changes(pages: DataFrame) -> DataFrame:
    """A log over the hosts of the pages, derived from digests of their names: blocked for a time, blocked for good, parent
    domains blocked, beginnings of paths allowed."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    digit = lambda k: F.ascii(F.substring(F.md5(F.col("host").cast("binary")), k, 1)) % 16
    day = lambda n: F.timestamp_seconds(F.lit(1_704_067_200) + n * 86_400)
    kind = digit(1)
    begun, ended = digit(2) * 20, digit(2) * 20 + (digit(3) + 1) * 15
    rows = hosts.select(
        F.explode(
            F.filter(
                F.array(
                    F.when(kind < 6, F.struct(F.col("host").alias("pattern"), F.lit("block").alias("action"), day(begun).alias("at"), F.lit("add").alias("change"))),
                    F.when(kind < 4, F.struct(F.col("host").alias("pattern"), F.lit("block").alias("action"), day(ended).alias("at"), F.lit("remove").alias("change"))),
                    F.when(kind < 2, F.struct(F.col("host").alias("pattern"), F.lit("block").alias("action"), day(ended + 30).alias("at"), F.lit("add").alias("change"))),
                    F.when(kind == 7, F.struct(F.substring_index("host", ".", -3).alias("pattern"), F.lit("block").alias("action"), day(begun).alias("at"), F.lit("add").alias("change"))),
                    F.when(kind.isin(0, 4, 7), F.struct(F.concat("host", F.lit("/en")).alias("pattern"), F.lit("allow").alias("action"), day(begun + 10).alias("at"), F.lit("add").alias("change"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("c")
    )
    return rows.select("c.*")


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filtered(demo_captures(pages), demo_changes(pages))


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, url, make_timestamp((1704067200 + page_id % 400 * 86400 + page_id % 86400) * 1000000) AS fetched_at,
         nullif(lower(rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1), '.')), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)(?::[0-9]*)?(/[^?#]*)?', 2) AS path
  FROM pages
), h AS (
  SELECT host, ascii(substr(md5(host), 1, 1)) % 16 AS kind, ascii(substr(md5(host), 2, 1)) % 16 * 20 AS begun,
         ascii(substr(md5(host), 2, 1)) % 16 * 20 + (ascii(substr(md5(host), 3, 1)) % 16 + 1) * 15 AS ended
  FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)
), log AS (
  SELECT host AS pattern, 'block' AS action, begun AS day, 'add' AS change FROM h WHERE kind < 6
  UNION SELECT host, 'block', ended, 'remove' FROM h WHERE kind < 4
  UNION SELECT host, 'block', ended + 30, 'add' FROM h WHERE kind < 2
  UNION SELECT array_to_string(list_slice(string_split(host, '.'), -3, -1), '.'), 'block', begun, 'add' FROM h WHERE kind = 7
  UNION SELECT host || '/en', 'allow', begun + 10, 'add' FROM h WHERE kind IN (0, 4, 7)
), i AS (
  SELECT pattern, action, change, make_timestamp((1704067200 + day::BIGINT * 86400) * 1000000) AS valid_from,
         make_timestamp((1704067200 + lead(day::BIGINT) OVER (PARTITION BY pattern, action ORDER BY day) * 86400) * 1000000) AS valid_to
  FROM (SELECT pattern, action, day, max(change) AS change FROM log GROUP BY ALL)
), m AS (
  SELECT p.page_id, i.pattern, i.action, i.valid_from,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.pattern) DESC, i.valid_from DESC, i.action DESC) AS nth
  FROM p JOIN i ON i.change = 'add' AND p.fetched_at >= i.valid_from AND (i.valid_to IS NULL OR p.fetched_at < i.valid_to)
   AND (p.host = split_part(i.pattern, '/', 1) OR ends_with(p.host, '.' || split_part(i.pattern, '/', 1)))
   AND (NOT contains(i.pattern, '/') OR starts_with(p.path || '/', '/' || split_part(i.pattern, '/', 2) || '/'))
)
SELECT p.page_id, p.url, p.fetched_at, p.host,
       CASE WHEN p.host IS NULL THEN 'invalid' ELSE coalesce(m.action, 'pass') END AS decision, m.pattern, m.valid_from
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.nth = 1
"""
