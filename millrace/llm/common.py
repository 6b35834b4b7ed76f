"""What several operators of this subpackage need: table access, bounded parts of Arrow batches, vocabulary files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from millrace.session import dropped, staged

__all__ = ["SPACE", "WORD", "dropped", "grouped", "parts", "staged", "table", "tokenizer_path", "unused"]

#: A word, for sizes and shingles: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a task works on at once; a longer text is a part of its own.
PART = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grouped(sizes: list[int], most: int = PART) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs whose sizes add up to `most`, or of one larger."""
    begin = size = 0
    for k, n in enumerate(sizes):
        if k > begin and size + n > most:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def parts(batches: Iterator[pa.RecordBatch], at: int = 1, most: int = PART) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some `most` bytes of text, or numbers of lists, in column `at`: what is made of a part stays small however many rows
    Spark puts in a batch, and however long they are."""
    for batch in batches:
        column = batch.column(at)
        sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
        for begin, end in grouped(pc.fill_null(sizes, 0).to_pylist(), most):
            yield batch.slice(begin, end - begin)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no column of that name."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def tokenizer_path(name: str) -> str:
    """A vocabulary file by path, or by its name among the public tokenizers of the machine that asks."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
