"""The corpus pipeline: documents in, token digests of the mix out. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, language_id, mixing, near_dedup, sentencepiece_codec
from millrace.llm.common import staged, table, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the documents themselves, and explained by a mixture of these.
    Texts that have none go: null, without letters, or in letters and runs of letters of no learned language. Null and
    repeated ids and rows are judged each by its text; an empty table gives an empty one; all columns stay."""
    names, p = language_id.learn(language_id.to_learn_from(docs))
    return language_id.accepted(docs, names, p)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, the document with the smallest doc_id, with all columns. Null texts count as
    empty; a null id loses to any other; of rows that repeat both one stays; an empty table gives an empty one."""
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id, with all columns. Documents without a
    doc_id or without words stay; rows that repeat an id stay or go together; an empty table gives an empty one."""
    gone = near_dedup.near_groups(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: rows are repeated, with all columns, or go. Null and empty texts have
    no words and go; a null source is a source of its own; rows that repeat id and text share what the mix takes of all
    of them; an empty table gives an empty one."""
    row, times, all_, n, place, first = (unused(docs, c) for c in ("_row", "_copies", "_all", "_n", "_place", "_first"))
    rows = docs.withColumn(row, F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256))
    copies = mixing.mixed(rows, id_col=row).groupBy(row).agg(F.sum("copies").alias(all_), F.count(F.lit(1)).alias(n))
    copies = staged(copies.where(F.col(all_) > 0))
    taken = rows.join(copies.where(F.col(n) == 1).select(row, F.col(all_).alias(times)), row)
    # rows that repeat id and text share the copies of all: alike, and what is left over goes to the first of them
    several = copies.where(F.col(n) > 1)
    if several.limit(1).count():
        again = staged(rows.join(several.select(row), row, "left_semi").withColumn(place, F.monotonically_increasing_id()))
        shares = several.join(again.groupBy(row).agg(F.min(place).alias(first)), row)
        own = F.expr(f"`{all_}` div `{n}` + IF(`{place}` = `{first}`, `{all_}` % `{n}`, 0)").alias(times)
        taken = taken.unionByName(again.join(shares, row).select(*docs.columns, row, own))
    return taken.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document of the mix. Null and empty texts have the begin and
    end ids alone; repeated rows are encoded each; an empty table gives an empty one."""
    return sentencepiece_codec.round_trip(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("SentencePiece", tokens)]

#: The last stage's ids are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
