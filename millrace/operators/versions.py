"""Versions of several tables that change together: a manifest names the files of all, and is written last.

Each version of a base folder has one manifest, a small text file whose name holds the version's number. A commit writes
the tables' rows to new folders, which nobody reads yet, and then the manifest, in one step that fails where another
commit has taken that number. Readers take the highest manifest, or the one they ask for; so they see all of a commit
or none of it, an interrupted one leaves the version before as it was, and a version that was read stays readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

NAME = "manifest-{:020d}.json"


class Conflict(Exception):
    """Another commit has the version that this one was to have."""


def _files(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def numbers(spark: SparkSession, base: str) -> list[int]:
    """The versions there are, in order."""
    files = _files(spark, base)
    if not files.exists(_path(spark, base)):
        return []
    names = [f.getPath().getName() for f in files.listStatus(_path(spark, base))]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def manifest(spark: SparkSession, base: str, version: int) -> dict:
    files, path = _files(spark, base), _path(spark, base, NAME.format(version))
    stream = files.open(path)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def current(spark: SparkSession, base: str) -> dict | None:
    """The manifest of the last version; none before the first commit."""
    there = numbers(spark, base)
    return manifest(spark, base, there[-1]) if there else None


def read(spark: SparkSession, base: str, table: str, schema: StructType, at: dict | None) -> DataFrame:
    """A table as of a manifest; empty where the manifest, or there is none, has no such table."""
    folders = at["tables"].get(table, []) if at else []
    return spark.read.schema(schema).parquet(*[f"{base}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def commit(spark: SparkSession, base: str, tables: dict[str, DataFrame], note=None, before: dict | None = None, add: bool = False) -> dict:
    """Writes a new version in which these tables have these rows, or with `add` these besides those they had; tables that
    are not named stay. before is the manifest that the rows were made from: where it is no longer the last one, the
    commit is refused with Conflict and nothing is changed. Returns the new manifest."""
    version = before["version"] + 1 if before else 0
    folders = dict(before["tables"]) if before else {}
    for name, rows in tables.items():
        folder = f"{name}/{version:020d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{base}/{folder}")
        folders[name] = [*folders.get(name, []), folder] if add else [folder]
    new = {"version": version, "note": note, "tables": folders}
    files = _files(spark, base)
    # written aside first: a manifest is there whole or not at all
    aside, path = _path(spark, base, f"_{uuid.uuid4().hex}"), _path(spark, base, NAME.format(version))
    stream = files.create(aside, False)
    stream.write(bytearray(json.dumps(new).encode()))
    stream.close()
    if files.exists(path) or not files.rename(aside, path):
        files.delete(aside, False)
        raise Conflict(f"version {version} of {base} is there already")
    return new
