"""Times next to a border: nanoseconds are more digits than a double has."""

from pyspark.sql import functions as F

from millrace.functions import times
from millrace.operators import backfill
from millrace.plans import digests
from millrace.streaming.deliveries import new_base

SECOND = 1_704_067_200 * 10**9
LAST = [SECOND + k * 10**9 + 999_999_999 - back for k in (0, 59, 86_399) for back in (0, 1, 100, 999)]


def test_the_last_nanoseconds_of_a_second_stay_in_it(spark):
    rows = spark.createDataFrame([(n,) for n in [*LAST, -1, 0, None]], "n bigint").select("n", times.rfc3339(F.col("n")).alias("t"))
    got = {r.n: r.t for r in rows.collect()}
    assert got[SECOND + 999_999_999] == "2024-01-01T00:00:00.999999999Z"
    assert got[-1] == "1969-12-31T23:59:59.999999999Z" and got[None] == ""
    back = spark.createDataFrame([(n, t) for n, t in got.items() if n], "n bigint, t string").select("n", times.parse_rfc3339(F.col("t")).alias("b"))
    assert all(r.n == r.b for r in back.collect())


def test_backfilled_values_keep_the_last_nanoseconds(spark):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(LAST)], "k int, n bigint").select("k", "n", times.rfc3339(F.col("n")).alias("stamp"), F.lit(None).cast("long").alias("nano"))
    base = new_base(spark, "times")
    backfill.run(rows, base, "k", "nano", times.parse_rfc3339(F.col("stamp")), batch=5)
    assert all(r.n == r.nano for r in backfill.filled(rows, base, "k", "nano").collect())


def test_a_signal_of_the_last_nanosecond_of_a_day_is_in_its_window(spark):
    day = spark.createDataFrame([("UTC", SECOND, SECOND + times.DAY)], "window_id string, from_nano bigint, until_nano bigint")
    signals = spark.createDataFrame([(n,) for n in (SECOND - 1, SECOND, SECOND + times.DAY - 1, SECOND + times.DAY)], "published_nano bigint")
    got = sorted(r.published_nano for r in digests.in_windows(signals, day).collect())
    assert got == [SECOND, SECOND + times.DAY - 1]
