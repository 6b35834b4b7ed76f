"""Sessions: settings the library relies on, the folder that all machines share, and the package's code on executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: UTC, because times without a zone are UTC in every table; adaptive execution for skew and partition sizes.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}


def build(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the library's settings; existing ones are kept where the caller's session has them."""
    builder = SparkSession.builder.appName("millrace")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. A session in one process (tests) may name none
    and gets a local one; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir names no folder that the driver and the executors of {master} share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "millrace")


def staged(df: DataFrame, *by: str, codec: str | None = None) -> DataFrame:
    """df, written once to the shared folder as Parquet and read again: it survives lost executors, cuts the
    lineage, and keeps a table that several plans read from being computed several times. With columns `by`, a folder for
    each of their values, of which a plan reads those it asks for."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """Folders that are listed inside, or by a stream that starts inside, are dealt to four tasks a core. Else each folder is a
    task, whose report to the driver is many times larger than the names that it found."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df, dealt by columns to four tasks a core: for small rows that much work follows on. A small file is a task or two, and
    adaptive execution puts small parts together again unless their number is given."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that rows of both sides move for. A staged file is many times smaller than its rows, and what Spark
    takes for small enough goes whole through the driver."""
    return df.hint("merge")


def dropped(*stages: DataFrame) -> None:
    """Removes the files of stages that nothing reads any more; whatever was made of them must be staged itself."""
    for df in stages:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once for each Spark context: their Python workers need not find it on a path."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(path)
    context._millrace_shipped = True


def shipped(udf: Callable) -> Callable:
    """A UDF whose code is this package's: where it is put in an expression, the active session's executors get the package."""

    @wraps(udf)
    def column(*args):
        ship(SparkSession.active())
        return udf(*args)

    return column


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow with a function that imports from this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
