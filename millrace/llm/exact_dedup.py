"""Exact deduplication by a content sort.

Normalised texts are range-partitioned by sampled splitters, sorted externally within each range so that equal texts
lie side by side, and each row is compared with its neighbour in full. Rows that a comparison finds equal are a run, whose
first row has the run's smallest identifier. Splitters stay small whatever the texts are: the sort key is the text's
beginning, a hash that parts long texts with one beginning, and a part number, then the whole text and the identifier.

A text with more than HOT rows is dealt into as many parts as the root of its count, so that no task sorts more than
that many of its rows; each part is a run, and one representative of each run is sorted and compared in full again.
The hash decides where a row is sorted, never whether two texts are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import dropped, staged, table, unused

#: Rows with one beginning and hash that are sorted together; above, they are dealt into parts.
HOT = 256
#: Code points of a text's beginning in the sort key.
BEGINNING = 24
#: White space that is not one plain space already.
LOOSE_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), LOOSE_SPACE, " ")


def mark(text: Column) -> Column:
    """Parts texts with one beginning; texts with one mark need not be equal."""
    return F.xxhash64(text)


def runs(rows: DataFrame, key: list[str], *carried: str) -> DataFrame:
    """rows (id, n, text, wanted, the key and the carried columns) in runs of equal text under a key: `run` is its number,
    `repeats` says whether the row before has the same text, keep_id is the run's smallest id and group_size the sum of n.
    The text goes, but for the `head` of a run where `wanted`."""
    order = Window.partitionBy(*key).orderBy("text", F.col("id").asc_nulls_last())
    compared = rows.repartitionByRange(*key).withColumn("repeats", F.coalesce(F.lag("text").over(order) == F.col("text"), F.lit(False)))
    # the windows ask for the rows of a key together: the ranges have them so, and nothing moves again
    numbered = compared.withColumn("run", F.sum((~F.col("repeats")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = numbered.select(*key, *carried, "id", "n", "run", "repeats", F.when(F.col("wanted") & ~F.col("repeats"), F.col("text")).alias("head"))
    of_run = Window.partitionBy(*key, "run")
    return numbered.withColumns({"keep_id": F.min("id").over(of_run), "group_size": F.sum("n").over(of_run)}).drop("n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null texts count as empty and are equal to each other and to empty ones. A null id loses to any other; where a
    group has none but null ids, keep_id is null and one row is kept. Rows that repeat id and text count in
    group_size, and one of them is kept. Other columns of docs are not read. An empty table gives an empty one.
    """
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    rows = staged(
        text.select(
            "id",
            "text",
            F.substring("text", 1, BEGINNING).alias("begins"),
            mark(F.col("text")).alias("mark"),
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.monotonically_increasing_id().alias("at"),
            F.lit(1).cast("long").alias("n"),
        )
    )
    hot = staged(rows.groupBy("begins", "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).withColumn("parts", F.ceil(F.sqrt("n"))).drop("n"))
    dealt = rows.join(hot, ["begins", "mark"], "left").withColumns({"wanted": F.col("parts").isNotNull(), "part": F.coalesce(F.pmod("at", F.col("parts")), F.lit(0))})

    key = ["begins", "mark", "part"]
    first = staged(runs(dealt, key, "digest", "wanted"))
    cold = first.where("NOT wanted").select("id", "keep_id", "group_size", ~F.col("repeats"), "digest")

    # the parts of a hot text: one representative of each run, with what its run counts
    heads = first.where("wanted AND NOT repeats").select(*key, F.col("run").alias("part_run"), F.col("keep_id").alias("id"), F.col("group_size").alias("n"), F.col("head").alias("text"), F.lit(False).alias("wanted"))
    again = staged(runs(heads, key[:2], "part", "part_run"))
    again = again.select(*key, F.col("part_run").alias("run"), F.col("keep_id").alias("keep"), F.col("group_size").alias("size"), F.col("repeats").alias("later"))
    warm = first.where("wanted").join(again, [*key, "run"]).select("id", "keep", "size", ~F.col("later") & ~F.col("repeats"), "digest")

    out = cold.toDF("id", "keep_id", "group_size", "kept", "digest").union(warm)
    dropped(rows, hot)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the one with the smallest id. Of rows that
    repeat both, one stays."""
    row = lambda digest: F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), digest)
    name = unused(docs, "_row")
    kept = exact_groups(docs, id_col, text_col).where("kept").select(row(F.col("text_sha256")).alias(name))
    rows = docs.withColumn(name, row(F.sha2(normalised(F.col(text_col)), 256)))
    return rows.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
