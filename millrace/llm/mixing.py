"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copies that each of its documents should have. The whole part is given to
all; the fractional part is a mass of words, at most the document's size. In a block of some BLOCK documents, longest
first, two are paired: mass moves between them at random, without bias for either and without loss, until one has none
or all of its words. That one is settled, the other is paired with the next. So a long document is settled by shorter
ones unless it outweighs them, and what a block leaves over is usually short. Blocks of such residuals leave one again,
and so on up a reduction tree until each source has one, whose last rounding is all that the words taken can miss the
target by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, staged, table

BLOCK = 128
#: Rows that repeat an id and are dealt by it alone.
HOT = 256
CAP = 3
WEIGHTS = (1, 2, 3)
SEED = 20_240


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with `place` (from 0) in this order and, for each of sums, its running total over the rows before. Rows are
    dealt by ranges of the order, each range adds up its own, and only the ranges' totals (one row for each) meet."""
    by = {f"_by{k}": c for k, c in enumerate(order)}
    parts = staged(rows.withColumns(by | {f"_add_{n}": c for n, c in sums.items()}).repartitionByRange(*[F.col(c).asc_nulls_last() for c in by]).withColumn("_range", F.spark_partition_id()))
    names = ["place", *sums]
    add = {n: F.col(f"_add_{n}") if n in sums else F.lit(1).cast("long") for n in names}
    totals = parts.groupBy("_range").agg(*[F.sum(add[n]).alias(f"_all_{n}") for n in names])
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_all_{n}").over(ranges), F.lit(0)).alias(f"_off_{n}") for n in names])
    inside = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_last() for c in by]).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({n: F.coalesce(F.sum(add[n]).over(inside), F.lit(0)) for n in names}).join(offsets, "_range")
    return out.select(*rows.columns, *[(F.col(n) + F.col(f"_off_{n}")).alias(n) for n in names])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (source, source_size): source, source_size, rank, weight, target. One row per source.

    Sources by code point, null last, get the weights in turn. Targets share the sum of all sizes by weight; one that
    would be above cap times its source's size stops there, and the rest is shared anew: in the order of that limit
    over the weight, the stopped ones are a beginning, found with running sums over ranges of the sources.
    """
    ranked = numbered(sizes.select("source", "source_size"), [F.col("source")]).withColumnRenamed("place", "rank")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("stop", (F.col("source_size") * cap).cast("double"))
    before = numbered(ranked, [F.col("stop") / F.col("weight"), F.col("rank")], stops=F.col("stop"), weights=F.col("weight")).drop("place")
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    share = (F.lit(float(whole["size"] or 0)) - F.col("stops")) / (F.lit(float(whole["weight"] or 0)) - F.col("weights"))
    part = staged(before.select("source", "source_size", "rank", "weight", "stop", share.alias("share"), (F.col("stop") / F.col("weight") > share).alias("free")))
    # the first source that is not stopped has what is left for it and all after it
    first = part.where("free").agg(F.min(F.struct(F.col("stop") / F.col("weight"), F.col("rank"), F.col("share"))).alias("at")).select("at.share").first()
    target = F.when(F.col("free"), F.col("weight") * F.lit(first["share"]).cast("double")).otherwise(F.col("stop"))
    return part.select("source", "source_size", "rank", "weight", target.alias("target"))


def uniform(seed: int, *cols: str) -> Column:
    """In [0, 1), the same on each run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") * F.lit(2.0**-53)


def duels() -> Column:
    """Folds the array `units` of (longest first, id, size, mass, u) to masses in the same order, of which one at most
    is neither 0 nor the size. Each keeps its mass on average."""
    return F.expr("""
transform(array_sort(aggregate(
  transform(slice(units, 2, size(units)), (x, i) -> named_struct('at', i + 1, 'size', double(x.size), 'mass', x.mass, 'u', x.u)),
  named_struct('at', 0, 'size', double(units[0].size), 'mass', units[0].mass, 'out', cast(array() as array<struct<at:int,got:double>>)),
  (own, x) -> transform(
    array(named_struct('up', greatest(0D, least(own.size - own.mass, x.mass)), 'down', greatest(0D, least(own.mass, x.size - x.mass)))),
    d -> CASE
      WHEN d.up + d.down <= 0 THEN named_struct('at', x.at, 'size', x.size, 'mass', x.mass, 'out', concat(own.out, array(named_struct('at', own.at, 'got', own.mass))))
      WHEN x.u * (d.up + d.down) < d.down AND d.up >= own.size - own.mass THEN
        named_struct('at', x.at, 'size', x.size, 'mass', x.mass - d.up, 'out', concat(own.out, array(named_struct('at', own.at, 'got', own.size))))
      WHEN x.u * (d.up + d.down) < d.down THEN
        named_struct('at', own.at, 'size', own.size, 'mass', own.mass + d.up, 'out', concat(own.out, array(named_struct('at', x.at, 'got', 0D))))
      WHEN d.down >= own.mass THEN
        named_struct('at', x.at, 'size', x.size, 'mass', x.mass + d.down, 'out', concat(own.out, array(named_struct('at', own.at, 'got', 0D))))
      ELSE named_struct('at', own.at, 'size', own.size, 'mass', own.mass - d.down, 'out', concat(own.out, array(named_struct('at', x.at, 'got', x.size))))
    END)[0],
  own -> concat(own.out, array(named_struct('at', own.at, 'got', own.mass))))), x -> x.got)""")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, size (words), source_size, target, copies (whole), taken (size times copies).

    Null and empty texts have size 0 and are not taken (copies is 0). A null source is a source of its own, the last.
    Null ids and rows that repeat an id are rounded like others; above HOT rows of one id its rows are told apart by their
    place in the table. Other columns of docs are not read. An empty table gives an empty one. The words taken of a
    source miss its target by less than the one document that is rounded last; no document has more than cap copies;
    the same table gives the same mix again.
    """
    rows = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("at")))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("units"))
    plan = targets(by_source.select("source", "source_size"), weights, cap).join(by_source.select(F.col("source").alias("_source"), "units"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = staged(plan.withColumns({"base": F.floor(rate).cast("int"), "fraction": rate - F.floor(rate)}))
    largest = plan.agg(F.max("units")).first()[0] or 0

    # rows are dealt by id, so that a mix does not depend on how the table lies; rows of a hot id by their place as well
    hot = staged(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(F.col("id").alias("_id"), F.lit(True).alias("hot")))
    keyed = rows.join(hot, F.col("id").eqNullSafe(F.col("_id")), "left").withColumn("key", F.xxhash64("id", F.when(F.col("hot"), F.col("at")))).drop("_id", "hot", "at")

    of_source = ["rank", "source_size", "target", "base"]
    known = plan.select(F.col("source").alias("_source"), *of_source, "fraction", F.col("units").alias("left"))
    units = keyed.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("mass", F.col("fraction") * F.col("size"))
    settled = [units.where("mass <= 0").select("id", "size", *of_source, F.lit(0).alias("extra"))]
    units = units.where("mass > 0").select("id", "key", "size", "mass", "left", *of_source)
    level = 0
    while largest > 1:  # each level leaves one residual for a block; two or three levels are a million documents
        blocks = F.ceil(F.col("left") / F.lit(BLOCK))
        here = units.withColumns({"blocks": blocks, "u": uniform(seed + 2 * level, "key"), "block": F.pmod(F.xxhash64(F.lit(seed + 2 * level + 1), "key"), blocks)})
        unit = F.struct((-F.col("size")).alias("longest"), "key", "id", "size", "mass", "u")
        folded = here.groupBy(*of_source, "blocks", "block").agg(F.array_sort(F.collect_list(unit)).alias("units"))
        folded = folded.select(*of_source, "blocks", F.explode(F.arrays_zip("units", duels().alias("got"))).alias("d"))
        folded = staged(folded.select("d.units.id", "d.units.key", "d.units.size", F.col("d.got").alias("mass"), "blocks", *of_source))
        whole = (F.col("mass") <= 0) | (F.col("mass") >= F.col("size"))
        settled.append(folded.where(whole).select("id", "size", *of_source, (F.col("mass") > 0).cast("int").alias("extra")))
        units = folded.where(~whole).select("id", "key", "size", "mass", F.col("blocks").alias("left"), *of_source)
        largest = -(-largest // BLOCK)
        level += 1
    last = F.when(uniform(seed + 2 * level, "key") * F.col("size") < F.col("mass"), 1).otherwise(0)
    settled.append(units.select("id", "size", *of_source, last.alias("extra")))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("extra")).otherwise(0)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
