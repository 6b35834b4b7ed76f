"""Retries that come due, in files one after the other with a restart, against plain Python."""

import random

from pyspark.sql import functions as F

from millrace.operators.delivery import DELAY
from millrace.streaming import retries

KIND = "delivery_id long, status string, attempt int, next_attempt_nano long, at_nano long"


def plain(rows: list[tuple], end: int) -> list[tuple]:
    out, by = [], {}
    for r in sorted(rows, key=lambda r: (r[4], r[2])):
        by.setdefault(r[0], []).append(r)
    for own in by.values():
        told = set()
        for k, r in enumerate(own):
            until = own[k + 1][4] if k + 1 < len(own) else end
            if r[1] == "retry" and r[3] <= until and r[2] not in told:
                told.add(r[2])
                out.append((r[0], r[2], r[3]))
    return sorted(out)


def test_retries_with_a_restart(spark, tmp_path):
    r, rows = random.Random(4), []
    for k in range(300):
        at = (k + 1) * 120 * 10**9
        status = r.choice(["retry", "retry", "due", "sent"])
        rows.append((r.randrange(25), status, r.randrange(1, 40), at + DELAY if status == "retry" else None, at))
    for k, part in enumerate((rows[:120], rows[120:200], rows[200:])):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k != 1:  # two files come before the first start of the second run
            stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            states = stream.withColumn("at", F.timestamp_micros((F.col("at_nano") / 1000).cast("long"))).withWatermark("at", "0 seconds")
            query = retries.due(states).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            query.awaitTermination()
    got = sorted(map(tuple, spark.read.schema(retries.DUE).parquet(f"{tmp_path}/out").collect()))
    want = plain(rows, max(x[4] for x in rows))
    assert (sorted(set(got) - set(want)), sorted(set(want) - set(got))) == ([], [])
    assert got == want and len(got) > 40
