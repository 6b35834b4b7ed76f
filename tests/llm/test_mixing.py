"""Targets by hand, and what a mix must satisfy."""

from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


def targets(sizes: dict) -> dict:
    """Sources by code point, null last, weigh 1, 2, 3; what is above three times a source's size is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    out, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit >= 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def held(docs):
    text = {(r.doc_id, r.source): len(brute.WORD.findall(r.text or "")) for r in docs.collect()}
    rows = mixing.mixed(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
    want = targets(dict(sizes))
    assert len(rows) == docs.count()
    by_target, largest = defaultdict(list), max(text.values(), default=0)
    for r in rows:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        by_target[(r.source_size, round(r.target, 3))].append(r)
    assert sorted(by_target) == sorted({(sizes[s], round(want[s], 3)) for s in sizes})
    for (_, target), some in by_target.items():
        same = sum((sizes[s], round(want[s], 3)) == (some[0].source_size, target) for s in sizes)
        assert abs(sum(r.taken for r in some) - same * target) <= same * largest
        rate = target / max(1, some[0].source_size)
        assert all(r.copies in (int(rate), int(rate) + 1) for r in some if r["size"] and abs(rate - round(rate)) > 1e-9)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held(docs)
    assert sorted(map(tuple, mixing.mixed(docs).collect())) == sorted(map(tuple, mixing.mixed(docs.repartition(5)).collect()))


def test_odd_documents(odd, none):
    held(odd)
    assert mixing.mixed(none).count() == 0


def test_many_documents_of_one_source_meet_the_target_closely(spark):
    rows = [(k, "w " * (1 + k * 7919 % 50), "hot" if k % 3 else f"s{k % 5}") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = defaultdict(lambda: [0, 0.0])
    for r in mixing.mixed(docs).select("source_size", "target", "taken").collect():
        got[r.source_size][0] += r.taken
        got[r.source_size][1] = r.target
    for taken, target in got.values():
        assert abs(taken - target) <= 51


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1}, {"a": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 100, "c": 1, "d": 1, None: 3}])
def test_targets(spark, sizes):
    plan = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {r.source: round(r.target, 6) for r in plan.collect()} == {s: round(t, 6) for s, t in targets(sizes).items()}


def test_rounding_is_without_bias_and_loses_nothing(spark):
    """One block, rounded with 40,000 different draws: each document has its mass on average, the block all of it always."""
    sizes, masses, n = [50, 31, 30, 12, 7, 7, 3, 1], [20.0, 30.5, 3.0, 6.0, 1.0, 6.5, 2.0, 0.5], 40_000
    unit = [F.struct(F.lit(-z).alias("longest"), F.lit(k).alias("id"), F.lit(z).cast("long").alias("size"), F.lit(m).alias("mass"), F.rand(k + 1).alias("u")) for k, (z, m) in enumerate(zip(sizes, masses, strict=True))]
    got = spark.range(n).select(F.array(*unit).alias("units")).select(mixing.duels().alias("got"))
    assert got.select(F.max(F.abs(F.aggregate("got", F.lit(0.0), lambda a, x: a + x) - sum(masses)))).first()[0] < 1e-6
    for k, (z, m) in enumerate(zip(sizes, masses, strict=True)):
        mean, spread = got.select(F.avg(F.col("got")[k]), F.stddev(F.col("got")[k])).first()
        assert abs(mean - m) <= 4.5 * spread / n**0.5 + 1e-9, (z, m, mean)


def test_a_hot_id_and_many_sources(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 1500).alias("source"))
    held(rows)
