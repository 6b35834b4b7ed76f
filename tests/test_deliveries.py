"""Reports on deliveries, one after the other in plain Python, against the batch fold and the stream; versions of tables."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import delivery, versions
from millrace.plans import catalog, services, streams
from millrace.streaming import deliveries

KIND = "delivery_id long, attempt_id string, attempted_nano long, event_id long, status string, sequence int, total int"
ORDER = ("attempted_nano", "event_id", "attempt_id", "delivery_id")
SHOWN = ["delivery_id", *streams.REPORTED[1:]]


def plain(rows: list[tuple]) -> list[tuple]:
    """What each delivery comes to, reports taken one by one in order."""
    owner, out = {}, {}
    for d, x, at, _, status, sequence, total in sorted(rows, key=lambda r: (r[2], r[3], r[1], r[0])):
        s = out.setdefault(d, {"status": "due", "attempt": 0, "confirmed": 0, "next": None, "inactive": False, "accepted": 0, "duplicate": 0, "terminal": 0, "conflict": 0})
        if x in owner:
            s["duplicate" if owner[x] == d else "conflict"] += 1
        elif s["status"] in delivery.TERMINAL:
            s["terminal"] += 1
        elif not (total > 0 and s["confirmed"] <= total and status in ("success", "failed", "blocked") and 0 <= sequence <= total and sequence in (0, s["confirmed"] + 1)):
            s["conflict"] += 1
        else:
            owner[x], s["next"] = d, None
            s["accepted"] += 1
            if status == "success" and 0 < sequence < total:
                s["status"], s["confirmed"] = "due", sequence
                continue
            s["attempt"] += 1
            if status == "success":
                s["status"], s["confirmed"] = "sent", total
            elif status == "blocked":
                s["status"], s["inactive"] = "blocked", True
            elif s["attempt"] < 3:
                s["status"], s["next"] = "retry", at + delivery.DELAY
            else:
                s["status"] = "failed"
    return sorted((d, *s.values()) for d, s in out.items())


def some_reports(seed: int, n: int, ids: int, many: int) -> list[tuple]:
    r = random.Random(seed)
    status = ["success"] * 5 + ["failed"] * 3 + ["blocked", "strange"]
    rows = [(r.randrange(many) if r.random() < 0.6 else 0, f"a{r.randrange(ids)}", r.randrange(n) * 10**9, k % 7, r.choice(status), r.choice([0, 1, 1, 2, 3, 4, -1]), r.choice([3, 3, 3, 2, 0])) for k in range(n)]
    return rows + rows[:5]


def got(df) -> list[tuple]:
    return sorted(map(tuple, df.select(*SHOWN).collect()))


@pytest.mark.parametrize(("seed", "ids", "many"), [(1, 10_000, 12), (2, 40, 8), (3, 12, 30)])
def test_batch_against_one_after_the_other(spark, seed, ids, many):
    rows = some_reports(seed, 300, ids, many)
    assert got(delivery.outcomes(spark.createDataFrame(rows, KIND).repartition(5), *ORDER)) == plain(rows)


def test_a_refused_report_owns_nothing(spark):
    """Delivery 1 reports x out of order and is refused; delivery 2 reports x soundly and has it; then 1 is in conflict."""
    rows = [(1, "x", 1, 0, "success", 2, 3), (2, "x", 2, 0, "success", 1, 3), (1, "x", 3, 0, "success", 1, 3), (1, "y", 4, 0, "success", 1, 3), (2, "x", 5, 0, "success", 2, 3)]
    assert got(delivery.outcomes(spark.createDataFrame(rows, KIND), *ORDER)) == plain(rows)
    assert {r.delivery_id: (r.accepted, r.duplicate, r.conflict) for r in delivery.outcomes(spark.createDataFrame(rows, KIND), *ORDER).collect()} == {1: (1, 0, 2), 2: (1, 1, 0)}


def test_owners_that_hang_on_each_other(spark):
    """Who has an id is settled by who has the one before, along a chain of deliveries."""
    rows = []
    for k in range(6):
        rows += [(k, f"x{k}", 10 * k, 0, "success", 1, 3), (k, f"x{k + 1}", 10 * k + 5, 0, "success", 2, 3)]
    assert got(delivery.outcomes(spark.createDataFrame(rows, KIND), *ORDER)) == plain(rows)


def test_no_reports(spark):
    assert got(delivery.outcomes(spark.createDataFrame([], KIND), *ORDER)) == []


def write(spark, rows, folder, part):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(folder)


def test_stream_with_restarts(spark, tmp_path, monkeypatch):
    """A file, a stop, two files, a batch that breaks off before its commit, a restart: as all in one."""
    monkeypatch.setattr(deliveries, "COMPACT", 2)
    rows = sorted(some_reports(5, 240, 60, 10), key=lambda r: (r[2], r[3], r[1], r[0]))
    cuts = [0, 60, 120, 180, len(rows)]
    folder, base = f"{tmp_path}/in", f"file://{tmp_path}/base"
    schema = spark.createDataFrame([], KIND).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for k in range(2):
        write(spark, rows[cuts[k] : cuts[k + 1]], folder, k)
        deliveries.run_available(stream(), base, *ORDER)
        assert got(deliveries.outcomes(spark, base, schema, *ORDER)) == plain(rows[: cuts[k + 1]])
    write(spark, rows[cuts[2] : cuts[3]], folder, 2)
    real = versions.commit

    def broken(*a, **b):
        raise RuntimeError("lost")

    monkeypatch.setattr(versions, "commit", broken)
    with pytest.raises(Exception, match="lost"):
        deliveries.run_available(stream(), base, *ORDER)
    assert got(deliveries.outcomes(spark, base, schema, *ORDER)) == plain(rows[: cuts[2]])
    monkeypatch.setattr(versions, "commit", real)
    write(spark, rows[cuts[3] :], folder, 3)
    deliveries.run_available(stream(), base, *ORDER)
    assert got(deliveries.outcomes(spark, base, schema, *ORDER)) == plain(rows)
    # a batch that comes again changes nothing
    deliveries.put(spark.createDataFrame(rows[cuts[3] :], KIND), 3, base, ORDER)
    assert got(deliveries.outcomes(spark, base, schema, *ORDER)) == plain(rows)


def test_stream_is_the_batch(spark, sf):
    shown = [c for c in streams.REPORTED]
    stream, batch = catalog.queries()["stream_deliveries"](spark, sf), catalog.queries()["delivery_outcomes"](spark, sf)
    assert sorted(map(tuple, stream.select(*shown).collect())) == sorted(map(tuple, batch.select(*shown).collect()))


def test_reports_of_the_query_cross_deliveries(spark, sf):
    rows = [tuple(r) for r in services.reports(spark, sf).select("delivery_id", "attempt_id", "attempted_nano", "event_id", "status", "sequence", "total").collect()]
    assert len({(r[1], r[0]) for r in rows}) > len({r[1] for r in rows})
    assert got(catalog.queries()["delivery_outcomes"](spark, sf)) == plain(rows)


def test_one_delivery_with_a_third_of_all_reports_is_in_no_array(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("delivery_id"), F.concat(F.lit("a"), "id").alias("attempt_id"), F.col("id").alias("attempted_nano"), F.col("id").alias("event_id"), F.lit("success").alias("status"), (F.col("id") % 5).cast("int").alias("sequence"), F.lit(9).alias("total"))
    out = delivery.outcomes(rows, *ORDER)
    assert "collect" not in out._jdf.queryExecution().toString().lower()
    assert got(out) == plain([tuple(r) for r in rows.collect()])


@pytest.mark.parametrize(("seed", "ids", "many"), [(7, 10_000, 12), (8, 40, 8)])
def test_deliveries_with_very_many_reports_in_parts(spark, monkeypatch, seed, ids, many):
    monkeypatch.setattr(delivery, "MOST", 20)
    rows = some_reports(seed, 300, ids, many)
    df = spark.createDataFrame(rows, KIND)
    dealt = {r.delivery_id: r.n for r in delivery.in_parts(delivery.placed(df, *ORDER), delivery.new_states(delivery.placed(df, *ORDER)).limit(0))[0].groupBy("delivery_id").agg(F.countDistinct("part").alias("n")).collect()}
    assert dealt[0] > 3 and min(dealt.values()) == 1
    assert got(delivery.outcomes(df, *ORDER)) == plain(rows)
