"""Backfills that can be stopped and resumed: a column of old rows, computed range by range of the key.

A range is a bounded number of the rows that still lack the value, in order of their key. Its values are one commit,
whose note is the last key done; a run that starts anew goes on behind it, and one that broke off before its commit does
the same range again. So each row is filled once, whenever and however often the work is stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import versions

BATCH = 500


def run(rows: DataFrame, base: str, key: str, column: str, value: Column, batch: int = BATCH, most: int | None = None) -> int:
    """Fills `column` of rows where it is null, range after range, at most `most` of them, and returns how many it did. The
    values are kept in the versions at base until rows are written anew. A value must not be null."""
    spark = rows.sparkSession
    done = 0
    while most is None or done < most:
        before = versions.current(spark, base)
        lack = rows.where(F.col(column).isNull())
        if before:
            lack = lack.where(F.col(key) > before["note"])
        ends = lack.orderBy(key).limit(batch).agg(F.max(key), F.count(F.lit(1))).first()
        if not ends[1]:
            return done
        some = lack.where(F.col(key) <= ends[0]).select(key, value.alias(column))
        versions.commit(spark, base, {"values": some}, note=ends[0], before=before, add=True)
        done += 1
    return done


def filled(rows: DataFrame, base: str, key: str, column: str) -> DataFrame:
    """rows with all values that were filled in so far."""
    spark = rows.sparkSession
    schema = StructType([rows.schema[key], rows.schema[column]])
    values = versions.read(spark, base, "values", schema, versions.current(spark, base)).withColumnRenamed(column, "_value")
    return rows.join(values, key, "left").withColumn(column, F.coalesce(column, "_value")).select(*rows.columns)
