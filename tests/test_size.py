"""What grows with the input: work is dealt to all tasks, steps are not repeated, and rows do not go through the driver."""

import contextlib
import io

from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import text
from millrace.operators import delivery, receipts, render, selection
from millrace.plans import catalog, digests, stores, streams
from millrace.sources import feeds
from millrace.streaming import retries


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_feeds_of_a_small_file_are_parsed_by_many_tasks(spark, sf):
    assert streams.bodies(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_accounting_does_not_repeat_its_expressions(spark, sf):
    assert len(catalog.queries()["feed_accounting"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()) < 50_000


def test_rows_of_signals_are_never_broadcast_for_their_small_file(spark, sf):
    shown = plan(digests.entity_groups(spark, sf))
    assert "BuildLeft" not in shown
    assert shown.count("Scan parquet") == 4  # the signals once and their names, each in the tree and below it


def test_kinds_are_told_without_a_join_of_items(spark):
    items = spark.createDataFrame([("w", "a", "EU", ["AI", "x"]), ("w", "b", None, []), ("v", "c", "eu", ["ai"]), ("w", "d", "", None)], "window_id string, identity string, region string, categories array<string>")
    likes = spark.createDataFrame([("w", ["Eu", ""], ["ai", "Data"]), ("w", ["us"], ["X"])], "window_id string, liked_regions array<string>, liked_categories array<string>")
    kinds = selection.with_kinds(items, likes)
    assert plan(kinds).count("Scan ExistingRDD (") == 2  # items once, likes once
    got = {r.identity: (r.kind.region, r.kind.categories) for r in kinds.collect()}
    assert got == {"a": ("eu", ["ai", "x"]), "b": ("", []), "c": ("", []), "d": ("", [])}


def test_slim_sources_have_the_same_keys(spark):
    rows = spark.createDataFrame([([("s", "u1"), ("s", "u2"), ("", "u1")],)], "sources array<struct<source_id:string,source_url:string>>")
    both = rows.select(selection.source_keys(F.col("sources")).alias("a")).collect() + selection.with_one_each(rows).select(selection.source_keys(F.col("sources")).alias("a")).collect()
    assert both[0].a == both[1].a == ["s", "url:u1"]


def test_signals_meet_windows_where_they_are(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(digests.in_windows(spark.range(9).selectExpr("id AS published_nano"), digests.windows(spark.createDataFrame([("UTC",)], "timezone string"))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown


def test_receipts_read_texts_and_attributions_once(spark, sf):
    shown = plan(catalog.queries()["receipt_violations"](spark, sf))
    assert "is_public_address" not in shown and "unescape_all(CASE WHEN RLIKE(regexp_replace" not in shown


def test_receipts_rank_lines_once_and_count_values_one_kind_at_a_time(spark, sf, monkeypatch):
    plans = []
    for module in (receipts, stores):
        write = getattr(module, "staged", session.staged)
        monkeypatch.setattr(module, "staged", lambda df, write=write: plans.append(plan(df)) or write(df), raising=False)
    plans.append(plan(catalog.queries()["receipt_violations"](spark, sf)))
    assert sum("row_number" in p for p in plans) == 1
    assert not any("Expand" in p for p in plans)


def test_answers_are_read_once_and_by_many_tasks(spark, sf):
    shown = plan(catalog.queries()["listed_items"](spark, sf))
    assert "from_json(StructField(id" not in shown
    items = spark.createDataFrame([(1, "{}", None, None)], "id bigint, body string, took_nano bigint, failed boolean")
    assert feeds.answers(items, 1).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_of_preferences_are_read_by_many_tasks(spark, sf):
    assert catalog.queries()["preferences_text"](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_thirds_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams.deliveries, "new_base", lambda *_: str(tmp_path))
    at = []
    streams.come_in_thirds(spark.range(0, 90, 1, 9), "id", "x", lambda stream: at.append(len(list((tmp_path / "files").glob("*.parquet")))))
    assert at[0] > 1 and at[0] < at[1] < at[2]
    assert spark.read.parquet(str(tmp_path / "files")).count() == 90


def test_a_batch_asks_the_state_of_a_delivery_once():
    calls = []

    class Store:
        def __getattr__(self, name):
            return lambda *_: calls.append(name) or (False if name in ("exists", "containsKey") else [] if name == "listTimers" else self)

    waiting = retries.Waiting()
    waiting.init(Store())
    calls.clear()
    rows = [Row(at_nano=k, attempt=k, status="retry", next_attempt_nano=k + 100) for k in range(50)]
    assert not list(waiting.handleInputRows((1,), iter(rows), None))
    assert calls == ["exists", "listTimers", "update", "registerTimer"]


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"source_id={k}").mkdir()
        (tmp_path / f"source_id={k}" / "body").write_text("x")
    tasks = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    before = tasks()
    rows = feeds.landing(spark, str(tmp_path))
    assert tasks() - before == 1  # one listing
    assert rows.count() == 60 and spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_folders_of_a_stream_are_listed_by_few_tasks(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"source_id={k}").mkdir()
        (tmp_path / f"source_id={k}" / "body").write_text("x")
    status = spark.sparkContext.statusTracker()
    before = set(status.getJobIdsForGroup())
    feeds.landing_stream(spark, str(tmp_path))
    jobs = [status.getJobInfo(j) for j in set(status.getJobIdsForGroup()) - before]
    assert jobs and all(status.getStageInfo(s).numTasks < 60 for j in jobs for s in j.stageIds)


def test_landed_files_are_written_by_many_tasks_and_read_once_each(spark, tmp_path):
    folder = str(tmp_path / "files")
    streams.land(spark.range(200).selectExpr("id AS source_id", "'x' AS body"), folder)
    assert len({f.name.split("-")[1] for f in (tmp_path / "files").rglob("*.txt")}) >= spark.sparkContext.defaultParallelism
    assert plan(feeds.read_landed(feeds.landing(spark, folder))).count("Scan binaryFile") == 4  # small ones and large ones, each in the tree and below it


def test_parts_of_a_block_are_worked_out_once(spark):
    item = "struct<place:int,startup_name:string,description:string,signal_type:string,region:string,categories:array<string>,funding:struct<round:string,amount:string,currency:string,investors:array<string>>,sources:array<struct<source_id:string,source_url:string>>>"
    rows = spark.createDataFrame(spark.sparkContext.emptyRDD(), f"k int, digest_date string, timezone string, items array<{item}>")
    shown = render.messages(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("📣 Сигнал") == 1


def test_stored_rows_are_ranked_once(spark, sf, monkeypatch):
    made, commit = [], stores.versions.commit
    monkeypatch.setattr(stores.versions, "commit", lambda s, base, tables, *a, **b: made.extend(plan(t).count("row_number") for t in tables.values()) or commit(s, base, tables, *a, **b))
    stores.stored_messages(spark, sf)
    assert made[0] and not any(made[1:])


def test_states_of_deliveries_meet_reports_by_shuffles(spark, monkeypatch):
    plans, write = [], delivery.staged
    monkeypatch.setattr(delivery, "staged", lambda df, *a, **b: plans.append(plan(df)) or write(df, *a, **b))
    rows = spark.range(90).selectExpr("id % 9 AS delivery_id", "'a' || id AS attempt_id", "id AS attempted_nano", "'success' AS status", "int(id % 4) AS sequence", "3 AS total")
    out = delivery.outcomes(rows, "attempted_nano")
    assert "Broadcast" not in plan(out) and sum("SortMergeJoin" in p for p in plans) > 3
    assert not any("BroadcastExchange" in p for p in plans)


def test_texts_are_decoded_in_batches_of_few_rows(spark, sf):
    """An Arrow batch is ten thousand rows, however long their texts are."""
    shown = plan(catalog.queries()["clean_feed_text"](spark, sf)) + plan(spark.createDataFrame([], "v array<string>").select(text.clean_strings(F.col("v"), 9, 80)))
    assert shown.count("BatchEvalPython (") > 1 and "ArrowEvalPython" not in shown
