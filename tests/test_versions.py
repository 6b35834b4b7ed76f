"""Tables that change together, backfills that stop, old files, landed bodies, and repeated keys of a batch."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import backfill, receipts, store, versions, worker
from millrace.sources import feeds

KINDS = {"a": "k long, v string", "b": "k long, n long"}


def tables(spark, base, at):
    return {t: sorted(map(tuple, versions.read(spark, base, t, spark.createDataFrame([], s).schema, at).collect())) for t, s in KINDS.items()}


def test_both_tables_or_neither(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/v"
    df = lambda t, rows: spark.createDataFrame(rows, KINDS[t])
    assert versions.current(spark, base) is None and tables(spark, base, None) == {"a": [], "b": []}
    first = versions.commit(spark, base, {"a": df("a", [(1, "x")]), "b": df("b", [(1, 1)])}, note="one")
    # a write of the second table that fails leaves the first as it was
    bad = df("b", [(2, 2)]).withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        versions.commit(spark, base, {"a": df("a", [(2, "y")]), "b": bad}, before=first)
    assert versions.current(spark, base) == first and tables(spark, base, first) == {"a": [(1, "x")], "b": [(1, 1)]}
    second = versions.commit(spark, base, {"a": df("a", [(2, "y")])}, before=first, add=True)
    assert tables(spark, base, versions.current(spark, base)) == {"a": [(1, "x"), (2, "y")], "b": [(1, 1)]}
    # one that was made from an old version is refused, and the old version stays readable
    with pytest.raises(versions.Conflict):
        versions.commit(spark, base, {"a": df("a", [])}, before=first)
    assert versions.current(spark, base) == second
    assert tables(spark, base, versions.manifest(spark, base, 0)) == {"a": [(1, "x")], "b": [(1, 1)]}


def test_a_foreign_signal_refuses_its_ingestion(spark, tmp_path):
    base = f"file://{tmp_path}/v"
    kinds = {"signals": spark.createDataFrame([], "id string, source_id string, name string").schema, "health": spark.createDataFrame([], "source_id string, status string, last_ingestion_nano long, last_attempt_nano long").schema}
    signals = spark.createDataFrame([("1", "a", "x", 1), ("2", "b", "y", 2), ("3", "a", "z", 2), ("4", "c", "w", 9)], "id string, source_id string, name string, ingestion long")
    health = spark.createDataFrame([("a", "ok", 1, 1, 1), ("b", "ok", 2, 2, 2)], "source_id string, status string, last_ingestion_nano long, last_attempt_nano long, ingestion long")
    refused = store.save_ingestions(spark, base, kinds, signals, health)
    assert sorted(r.ingestion for r in refused.collect()) == [2, 9]
    at = versions.current(spark, base)
    assert [tuple(r) for r in versions.read(spark, base, "signals", kinds["signals"], at).collect()] == [("1", "a", "x")]
    assert [r.source_id for r in versions.read(spark, base, "health", kinds["health"], at).collect()] == ["a"]


@pytest.mark.parametrize("stops", [[1], [2, 1], [], [100]])
def test_a_backfill_that_stops_gives_the_whole_table_once(spark, tmp_path, monkeypatch, stops):
    base = f"file://{tmp_path}/b"
    rows = spark.createDataFrame([(k, str(k), None if k % 3 else 5) for k in range(40)], "k long, t string, v long")
    done = [backfill.run(rows, base, "k", "v", F.col("t").cast("long") * 2, batch=10, most=n) for n in stops]
    real = versions.commit
    monkeypatch.setattr(versions, "commit", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
    if sum(done) < 3:
        with pytest.raises(RuntimeError):
            backfill.run(rows, base, "k", "v", F.col("t").cast("long") * 2, batch=10)
    monkeypatch.setattr(versions, "commit", real)
    backfill.run(rows, base, "k", "v", F.col("t").cast("long") * 2, batch=10)
    assert backfill.run(rows, base, "k", "v", F.col("t").cast("long"), batch=10) == 0
    assert sorted(map(tuple, backfill.filled(rows, base, "k", "v").collect())) == [(k, str(k), 2 * k if k % 3 else 5) for k in range(40)]


def test_repeated_keys_of_a_batch_are_saved_one_after_the_other(spark):
    kind = "source_id string, status string, last_ingestion_nano long, last_attempt_nano long"
    old = spark.createDataFrame([("a", "old", 1, 7)], kind)
    new = spark.createDataFrame([("a", "x", 2, None, 1), ("a", "z", 4, None, 3), ("a", "y", 3, 8, 2), ("b", "x", 1, None, 1), ("b", "y", 2, None, 2)], f"{kind}, n long")
    assert sorted(map(tuple, store.save_health(old, new, "n").collect())) == [("a", "z", 4, 8), ("b", "y", 2, None)]
    kind = "id string, v long"
    got = store.save_signals(spark.createDataFrame([("s", 0)], kind), spark.createDataFrame([("s", 5, 2), ("s", 6, 1), ("t", 1, 1), ("t", 1, 1)], f"{kind}, n long"), "n")
    assert sorted(map(tuple, got.collect())) == [("s", 5), ("t", 1)]


def test_landed_bodies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in {"a.xml": "<x/>", "b.xml": "y" * 500, "c": "é", "d.rss": " "}.items():
        (tmp_path / "in" / name).write_text(body)
    want = [("a", "<x/>", None), ("b", None, "response_size"), ("c", "é", None), ("d", " ", None)]
    assert sorted(map(tuple, feeds.landing(spark, f"{tmp_path}/in", 100).collect())) == want
    # a large file is not opened: its content is not even asked for
    large = feeds.landing(spark, f"{tmp_path}/in", 100).where("error IS NOT NULL")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in [x for x in large.split("FileScan") if "length" in x and ">" in x][-1].split("Batched")[0].replace("null AS content", "")
    run = lambda: feeds.landing_stream(spark, f"{tmp_path}/in", 100, 2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    run()
    (tmp_path / "in" / "e.xml").write_text("<z/>")
    run()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [*want, ("e", "<z/>", None)]


def test_a_worker_stops_at_the_first_failure(spark):
    kind = "delivery_id long, at int, sequence int, attempted_nano long, answer string, message_id string, error_code string"
    rows = [(1, 0, 1, 0, "ok", "a", None), (1, 1, 2, 0, "blocked", None, "403"), (1, 2, 3, 0, "ok", "c", None), (2, 0, 0, 0, "ok", "d", None), (2, 1, 1, 0, "ok", "e", None), (3, 0, None, 0, "ok", "f", None), (4, 0, 1, 0, "unavailable", None, None), (5, 0, 1, 0, "ok", "g", None), (5, 1, 2, 0, "ok", "h", None)]
    got = worker.reports(spark.createDataFrame(rows, kind))
    assert sorted((r.delivery_id, r.sequence, r.status, r.message_id, r.error_code) for r in got.collect()) == [(1, 1, "success", "a", None), (1, 2, "blocked", None, "403"), (4, 1, "failed", None, None), (5, 1, "success", "g", None), (5, 2, "success", "h", None)]
    assert sorted(map(tuple, worker.sent(got).collect())) == [(1, 1), (4, 0), (5, 2)]


def test_receipts(spark):
    one = lambda rows, kind: spark.createDataFrame(rows, kind)
    attributions = '[{"source_id": "s", "source_url": "https://x.example/?a=1&b=2"}]'
    deliveries = one([("d", "g", 1, 1), ("e", "none", 1, 1), ("f", "h", 1, 1)], "delivery_id string, digest_id string, attempt int, confirmed_through int")
    runs = one([("g", 1), ("h", 0)], "digest_id string, candidate_count int")
    items = one([("g", 1, "c", "A & B", attributions)], "digest_id string, rank int, candidate_identity string, startup_name string, attributions_json string")
    text = '<b>A &amp; B</b>\nИсточники: <a href="https://x.example/?a=1&amp;b=2">s</a>'
    messages = lambda t, u: one([("d", 0, 1, t, "HTML"), ("f", 0, 1, u, "HTML")], "delivery_id string, at int, sequence int, text string, parse_as string")
    attempts = one([("d", "failed", None), ("d", "success", "m"), ("f", "success", "m")], "delivery_id string, status string, message_id string")
    health = lambda status: one([("s", status)], "source_id string, status string")
    empty = "Подходящих стартапов за этот день не найдено."
    kinds = lambda *a: sorted(map(tuple, receipts.violations(*a).collect()))
    assert kinds(deliveries, runs, items, messages(text, empty), attempts, health("ok")) == []
    assert kinds(deliveries, runs, items, messages(text.replace("&amp; B", ""), "?"), attempts, health("failed")) == [("d", "rendered_item_missing"), ("d", "source_access_unavailable"), ("f", "rendered_empty_state_missing"), ("f", "source_access_unavailable")]
    assert ("d", "source_health_missing") in kinds(deliveries, runs, items, messages(text, empty), attempts, health("ok").limit(0))
