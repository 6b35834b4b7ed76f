"""Ranked lexical search, impact-ordered and score-at-a-time.

An impact is what one term adds to the score of one document, as an exact integer. The index holds, for each term and
each exact impact, the documents that have it, in segments of bounded size, and is written by levels of impact from the
highest. A round reads one level and adds its impacts to the partial scores of the items that are still open. After each
round the greatest impact left of each term bounds what any document can still gain: where that is less than the
partial score of an item's k-th document, no document that was not met can be among the first k, and the item is closed
with those documents that can. Only these get their whole scores, from the documents' own lists of terms. So the long
segments of frequent words are read for no item that its rare words decide.

The index has the terms of the queries alone. Tasks that read the texts know these by a bit map of fixed size; the few
others that it lets through go when terms are joined exactly.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import dropped, parts, staged, table
from millrace.session import map_arrow

TOP = 20
#: Bits of the map of the queries' terms.
BITS = 1 << 20
#: Documents of a segment, about.
SEGMENT = 4096
#: The last level; the levels before it each go down to half of the impact of the one before.
LAST = 6
#: Parts that the join of terms with their weights deals each term into.
SALTS = 32
# The score's constants, in whole thousandths.
SCALE, GAIN, LENGTH = 1_000_000_000, 1000, 12
#: What a term is made of: digits, letters in lower case and all that is not ASCII; anything else parts terms.
TERMS = bytes(c if chr(c).isalnum() and c < 128 and not 65 <= c <= 90 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(TERMS).split()


def counted(rows: DataFrame, bits: np.ndarray | None) -> DataFrame:
    """(row, id, n, terms, tfs) of rows (id, text): the number of terms with repeats, and the distinct ones that the map
    lets through with their occurrences. Rows are numbered, since identifiers may repeat."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in parts(batches):
            n, terms, tfs = [], [], []
            for text in b.column(1).to_pylist():
                found = terms_of(text)
                own = Counter(found)
                some = own if bits is None else [t for t in own if bits[zlib.crc32(t) % BITS]]
                n.append(len(found))
                terms.append(list(some))
                tfs.append([own[t] for t in some])
            numbers = pa.array(np.arange(row, row + len(b)))
            row += len(b)
            yield pa.RecordBatch.from_arrays([numbers, b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.binary())), pa.array(tfs, pa.list_(pa.int64()))], names=["row", "id", "n", "terms", "tfs"])

    return map_arrow(rows, run, f"row long, id {kind}, n long, terms array<binary>, tfs array<long>")


def bit_map(wanted: DataFrame) -> np.ndarray:
    """Which of BITS hashes the terms have: at most so many numbers come to the driver."""
    bits = np.zeros(BITS, bool)
    for r in wanted.select(F.pmod(F.crc32("term"), F.lit(BITS)).alias("bit")).distinct().collect():
        bits[r.bit] = True
    return bits


def whole_div(a: str, b: str) -> Column:
    return F.expr(f"({a}) div ({b})")


def weighted(index: DataFrame, wanted: DataFrame, documents: int) -> DataFrame:
    """(term, df, w) of the wanted terms that some document has and that weigh more than 0, as a stage."""
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1)))
    return staged(df.join(wanted.select("term").distinct(), "term").select("term", "df", w.alias("w")).where("w > 0"))


def with_impacts(rows: DataFrame, weights: DataFrame, documents: int, terms: int) -> DataFrame:
    """rows (row, n, term, tf, ...) of weighted terms with df, impact. A term is dealt into SALTS parts."""
    parts_ = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    m = whole_div(f"25 * n * {documents}", f"{max(1, terms)}") + 75
    met = salted.join(parts_, ["term", "salt"]).withColumn("m", m)
    return met.withColumn("impact", F.col("w") * whole_div(f"{SCALE} * tf", f"{GAIN} * tf + {LENGTH} * m")).drop("salt", "m", "w").where("impact > 0")


def segments(postings: DataFrame, greatest: int) -> DataFrame:
    """(term, bucket, impact, rows, level) as a stage with a folder for each level: level 0 has impacts above half of the
    greatest there can be. The documents of a term are dealt into buckets by its df, so a segment has some SEGMENT
    documents at most."""
    bucket = F.pmod(F.xxhash64("row"), F.ceil(F.col("df") / SEGMENT)).cast("int")
    below = F.floor(F.log2(F.lit(float(greatest)) / F.col("impact"))).cast("int")
    level = F.least(F.greatest(below, F.lit(0)), F.lit(LAST)).alias("level")
    found = postings.select("term", bucket.alias("bucket"), "impact", "row").groupBy("term", "bucket", "impact").agg(F.collect_list("row").alias("rows"))
    return staged(found.select("*", level), "level")


def closed(partial: DataFrame, items: DataFrame, left: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(item, bound, least) of the items that no further level can change but in the scores of documents already met, and
    (item) of the others. left has the greatest impact that is left of each term."""
    gain = items.join(left, "term").groupBy("item").agg(F.sum(F.col("qtf") * F.col("impact")).alias("bound"))
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.col("partial").desc()))
    kth = partial.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("item").agg(F.min(F.when(F.col("nth") == most, F.col("partial"))).alias("least"))
    state = items.select("item").distinct().join(gain, "item", "left").join(kth, "item", "left").select("item", F.coalesce("bound", F.lit(0)).alias("bound"), F.coalesce("least", F.lit(0)).alias("least"))
    state = staged(state.withColumn("over", (F.col("bound") == 0) | (F.col("bound") < F.col("least"))))
    return state.where("over"), state.where("NOT over").select("item")


def candidates(index: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """(item, row) of documents that can be among the first of an item."""
    open_, partial, found = items, None, None
    most_of = staged(index.groupBy("term", "level").agg(F.max("impact").alias("impact"), F.max("bucket").alias("last")))
    for level in range(LAST + 1):
        buckets = most_of.where(F.col("level") == level).select("term", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bucket"))
        now = index.where(F.col("level") == level).select("term", "bucket", "impact", "rows")
        met = open_.join(buckets, "term").join(now, ["term", "bucket"])
        met = met.select("item", (F.col("qtf") * F.col("impact")).alias("partial"), F.explode("rows").alias("row"))
        met = met if partial is None else met.unionByName(partial)
        sums = staged(met.groupBy("item", "row").agg(F.sum("partial").alias("partial")))
        left = most_of.where(F.col("level") > level).groupBy("term").agg(F.max("impact").alias("impact"))
        over, more = closed(sums, open_, left, most)
        some = staged(sums.join(over, "item").where(F.col("partial") + F.col("bound") >= F.col("least")).select("item", "row"))
        found = some if found is None else found.unionByName(some)
        if not more.limit(1).count():
            break
        open_ = staged(open_.join(more, "item"))
        partial = sums.join(more, "item")
    return found


def ranked(docs: DataFrame, queries: DataFrame, most: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each row of queries the documents with the highest scores above 0, ties by doc_id.

    Null and empty texts have no terms: such documents are in no count, and such queries find nothing. Rows of docs that
    repeat an id are documents of their own, and rows of queries that repeat one are queries of their own, each with
    its ranks from 1; of documents with the same score and id either may come first. Null ids come last. Other columns
    are not read. Without documents, or queries, the result is empty.
    """
    asked = staged(counted(queries.select(F.col(query_id).alias("id"), F.col(query_text).alias("text")), None))
    items = staged(asked.select(F.col("row").alias("item"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.tfs").alias("qtf")))
    index = staged(counted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), bit_map(items)))
    documents, terms = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = weighted(index, items, documents)
    listed = lambda rows, *more: rows.select(*more, "row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(*more, "row", "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    heaviest = weights.agg(F.coalesce(F.max("w"), F.lit(1))).first()[0]
    by_impact = segments(with_impacts(listed(index), weights, documents, terms), heaviest * SCALE // GAIN)
    some = candidates(by_impact, items, most)
    whole = listed(index.join(some, "row"), "item", "id").join(items, ["item", "term"])
    scores = with_impacts(whole, weights, documents, terms).groupBy("item", "row", "id").agg(F.sum(F.col("qtf") * F.col("impact")).alias("score"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    first = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    out = first.join(asked.select(F.col("row").alias("item"), F.col("id").alias("query")), "item")
    return out.select(F.col("query").alias(query_id), "rank", F.col("id").alias(id_col), "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"unnest(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS_SQL.format("text")} AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, {_TERMS_SQL.format("text")} AS term FROM benchmark) GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN size USING (doc_id), total GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
"""
