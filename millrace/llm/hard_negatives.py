"""Hard negatives by distributed radix selection over integer scores.

Vectors are quantised, so that a score is an exact integer. Each anchor and each of its positives open a window of
scores; of the rows of other labels in it the first few are wanted, by score and then by identifier. A pass over all rows
counts, for each window, how many scores begin with each digit (counted down from the window's upper end); the sums tell
the bucket in which the last wanted row lies, and the next pass counts the following digit inside that bucket alone. Ties
at one score are parted by the digits of the identifier in the same way. When every window's last bucket is known to hold
no more than is wanted, one pass gathers the rows up to it and nothing else.

A task sends, for each window, only the cells up to the one in which its own count reaches what is wanted, as the last
wanted row of all cannot lie beyond: never more cells than wanted rows, however wide the digit. Anchors are taken in
blocks of bounded size, each held against all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import dropped, staged, table
from millrace.session import map_arrow, shared_dir

POSITIVES, NEGATIVES = 5, 10
#: The window's ends in hundredths of the positive's score.
LOW, HIGH = 30, 90
SCALE = 256
#: Bits of a digit.
DIGIT = 10
#: A block has this many anchors and this many numbers in its vectors at most (or one anchor).
ANCHORS, NUMBERS = 1024, 1 << 20
#: Scores that a task has at once.
CELLS = 1 << 22
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, q) of the rows that take part: no null among identifier, label, vector and components, all of these
    finite. A component x becomes floor(SCALE * x)."""
    vector = F.col(vector_col)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vector.isNotNull() & sound)
    return some.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("q"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of `dims`; what a shorter vector lacks is 0, what a longer one has beyond meets no anchor."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims), np.int64)
    row, begin = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(flat)) - begin
    out[row[place < dims], place[place < dims]] = flat[place < dims]
    return out


class Block:
    """Anchors of a block, and its windows in order of anchors: what every task is given."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[list[int]]):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        self.dims = max(map(len, vectors))
        self.vectors = matrix(pa.array(vectors, pa.list_(pa.int64())), self.dims)

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, labels, scores of anchors x rows) of all rows. In doubles where these are exact, else in 64-bit integers."""
        step = max(1, CELLS // len(self.ids))
        largest = float(np.abs(self.vectors.astype(float)).max(initial=0))
        for whole in batches:
            for begin in range(0, len(whole), step):
                b = whole.slice(begin, step)
                m = matrix(b.column(2), self.dims)
                exact = largest * float(np.abs(m.astype(float)).max(initial=0)) * self.dims < 2**53
                s = (self.vectors.astype(float) @ m.T.astype(float)).astype(np.int64) if exact else self.vectors @ m.T
                yield b.column(0).to_numpy(), b.column(1).to_numpy(), s


def positives(rows: DataFrame, block: Block, most: int) -> list[tuple[int, int, int]]:
    """(anchor's place, score, id) of each anchor's first positives, in order. A task keeps its own first ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = [np.zeros(0, np.int64)] * len(block.ids)
        ident = list(score)
        for ids, labels, s in block.scored(batches):
            for a in range(len(block.ids)):
                near = np.flatnonzero((labels == block.labels[a]) & (ids != block.ids[a]))
                if len(score[a]) == most:
                    near = near[s[a, near] >= score[a][-1]]
                if len(near):
                    x, i = np.concatenate([score[a], s[a, near]]), np.concatenate([ident[a], ids[near]])
                    first = np.lexsort((i, -x))[:most]
                    score[a], ident[a] = x[first], i[first]
        n = [len(x) for x in score]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n), pa.int32()), pa.array(np.concatenate(score)), pa.array(np.concatenate(ident))], names=["anchor", "score", "id"])

    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id"))
    found = map_arrow(rows, run, "anchor int, score long, id long").withColumn("nth", nth).where(F.col("nth") <= most)
    return sorted(((r.anchor, r.score, r.id) for r in found.collect()), key=lambda r: (r[0], -r[1], r[2]))


class Windows:
    """The windows of a block and how far the search in each has come.

    A row's place in a window is down = hi - score, and among rows of one score up = id - least id. Digits of `down` are
    looked at first, from the highest. `prefix` is down >> shift of the bucket with the last wanted row; with tied set,
    down is known in full (exactly) and prefix is that of up. need is what is wanted out of the bucket.
    """

    def __init__(self, block: Block, found: list[tuple[int, int, int]], low: int, high: int, wanted: int, least_id: int, last_id: int):
        spans = [(a, -(-low * p // 100), high * p // 100, p, i) for a, p, i in found]
        spans = [x for x in spans if x[1] <= x[2]]
        column = lambda k: np.array([x[k] for x in spans], np.int64)
        self.anchor, lo, self.hi, self.positive_score, self.positive_id = (column(k) for k in range(5))
        self.width = self.hi - lo
        self.begin = np.searchsorted(self.anchor, np.arange(len(block.ids) + 1))
        n = len(spans)
        self.least_id, self.wanted = least_id, wanted
        self.score_bits, self.id_bits = int(self.width.max(initial=0)).bit_length(), (last_id - least_id).bit_length()
        self.prefix, self.need, self.open = np.zeros(n, np.uint64), np.full(n, wanted), np.ones(n, bool)
        self.shift, self.tied, self.exactly = np.full(n, self.score_bits), np.zeros(n, bool), np.zeros(n, np.int64)

    def passes(self) -> Iterator[tuple[bool, int, int]]:
        """(whether by id, shift before, shift after) of each digit."""
        for by_id, bits in ((False, self.score_bits), (True, self.id_bits)):
            at = bits
            while at > 0:
                yield by_id, at, max(0, at - DIGIT)
                at = max(0, at - DIGIT)

    def places(self, a: int, some: np.ndarray, ids: np.ndarray, labels: np.ndarray, s: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(down as windows x rows, whether inside, the rows) of anchor a's windows `some` and the rows of other labels."""
        rows = np.flatnonzero((labels != block.labels[a]) & (ids != block.ids[a]))
        down = self.hi[some][:, None] - s[a, rows][None, :]
        return down, (down >= 0) & (down <= self.width[some][:, None]), rows

    def up(self, ids: np.ndarray) -> np.ndarray:
        return ids.astype(np.uint64) - np.uint64(self.least_id % (1 << 64))

    def up_to_bucket(self, some: np.ndarray, down: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a row is in a window's last bucket or before it."""
        tied, exactly, prefix, shift = (x[some][:, None] for x in (self.tied, self.exactly, self.prefix, self.shift.astype(np.uint64)))
        by_score = down.astype(np.uint64) >> shift <= prefix
        by_id = (down < exactly) | ((down == exactly) & (self.up(ids)[None, :] >> shift <= prefix))
        return np.where(tied, by_id, by_score)


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x >> by, also for a shift by all bits."""
    return x >> np.uint64(by) if by < 64 else np.zeros_like(x)


def counted(rows: DataFrame, block: Block, w: Windows, by_id: bool, before: int, after: int) -> list:
    """For each open window (place, digit, n up to and with it, n in it) of the bucket of the next digit that holds the last
    wanted row; a digit of null where there are fewer."""
    size = 1 << (before - after)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(w.anchor), size), np.int64)
        for ids, labels, s in block.scored(batches):
            up = w.up(ids)
            for a in range(len(block.ids)):
                some = np.arange(w.begin[a], w.begin[a + 1])
                some = some[w.open[some]]
                if len(some):
                    down, inside, at = w.places(a, some, ids, labels, s, block)
                    key = np.broadcast_to(up[at][None, :], down.shape) if by_id else down.astype(np.uint64)
                    inside &= shifted(key, before) == w.prefix[some][:, None]
                    if by_id:
                        inside &= down == w.exactly[some][:, None]
                    k, row = np.nonzero(inside)
                    digit = (key[k, row] >> np.uint64(after) & np.uint64(size - 1)).astype(np.int64)
                    cells[some] += np.bincount(k * size + digit, minlength=len(some) * size).reshape(len(some), size)
        # beyond the cell in which this task alone has what is wanted, no cell matters
        cells[cells.cumsum(1) - cells >= w.need[:, None]] = 0
        k, digit = np.nonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(digit, pa.int32()), pa.array(cells[k, digit]), pa.array(w.need[k].astype(np.int64))], names=["window", "digit", "n", "need"])

    sums = map_arrow(rows, run, "window int, digit int, n long, need long").groupBy("window", "digit", "need").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("window").orderBy("digit"))
    reached = F.when(F.col("total") >= F.col("need"), F.struct("digit", "total", "n"))
    return sums.withColumn("total", total).groupBy("window").agg(F.min(reached).alias("cell")).select("window", "cell.*").collect()


def narrowed(rows: DataFrame, block: Block, w: Windows) -> None:
    """Looks at digit after digit until every window's last bucket holds no more than is wanted, or equal keys only."""
    for by_id, before, after in w.passes():
        if by_id and before == w.id_bits:  # what is open still has more rows of one score than it needs
            w.tied, w.exactly = w.open.copy(), np.where(w.open, w.prefix, 0).astype(np.int64)
            w.prefix, w.shift = np.where(w.open, 0, w.prefix).astype(np.uint64), np.where(w.open, w.id_bits, w.shift)
        if not w.open.any():
            return
        found = {r.window: r for r in counted(rows, block, w, by_id, before, after)}
        for k in np.flatnonzero(w.open):
            r = found.get(int(k))
            if r is None or r.digit is None:  # fewer than wanted: all of the bucket
                w.open[k] = False
                continue
            w.prefix[k] = int(w.prefix[k]) << (before - after) | r.digit
            w.shift[k] = after
            w.need[k] -= r.total - r.n
            w.open[k] = r.n > w.need[k]


def gathered(rows: DataFrame, block: Block, w: Windows) -> DataFrame:
    """The rows up to each window's last bucket, ranked. Rows that repeat identifier and score may be more than wanted; a
    task sends no more of a window than are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[np.ndarray, ...]] = []
        for ids, labels, s in block.scored(batches):
            for a in range(len(block.ids)):
                some = np.arange(w.begin[a], w.begin[a + 1])
                if len(some):
                    down, inside, at = w.places(a, some, ids, labels, s, block)
                    k, row = np.nonzero(inside & w.up_to_bucket(some, down, ids[at]))
                    got.append((some[k], ids[at[row]], s[a, at[row]]))
            got = [first(got, w.wanted)]
        k, ident, score = got[0] if got else (np.zeros(0, np.int64),) * 3
        columns = [block.ids[w.anchor[k]], w.positive_id[k], ident, w.positive_score[k], score]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), *map(pa.array, columns)], names=["window", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = map_arrow(rows, run, "window int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    nth = F.row_number().over(Window.partitionBy("window").orderBy(F.col("negative_score").desc(), "negative_id"))
    ranked = found.withColumn("rank", nth).where(F.col("rank") <= w.wanted)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def first(got: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """Of (window, id, score) the first of each window."""
    k, ident, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((ident, -score, k))
    k, ident, score = k[order], ident[order], score[order]
    nth = np.arange(len(k)) - np.searchsorted(k, k)
    return k[nth < most], ident[nth < most], score[nth < most]


def blocks(anchors: DataFrame) -> Iterator[Block]:
    """The anchors (id, label, q, at) in blocks, in order of id; one block at a time is with the driver."""
    after = None
    while True:
        left = anchors if after is None else anchors.where((F.col("id") > after[0]) | ((F.col("id") == after[0]) & (F.col("at") > after[1])))
        dims = max(1, left.orderBy("id", "at").limit(ANCHORS).agg(F.max(F.size("q"))).first()[0] or 0)
        some = left.orderBy("id", "at").limit(max(1, min(ANCHORS, NUMBERS // dims))).collect()
        if not some:
            return
        yield Block([r.id for r in some], [r.label for r in some], [r.q for r in some])
        after = some[-1].id, some[-1].at


def mined(rows: DataFrame, anchors: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row for which `anchors` holds and
    each of its first positives (other rows of its label), the first rows of other labels whose score is from `low` to `high`
    hundredths of the positive's. Order is by score from the highest, then by identifier.

    rows has an integer identifier, a label and a vector of numbers. Rows with a null in any of these, in the vector or
    with a component that is not finite take no part. Components that a shorter vector lacks are 0; an empty vector has
    score 0 with all. Scores are 64-bit integers, as Spark's. Rows that repeat an identifier are rows of their own, each an
    anchor of its own, and none is a positive or negative of its own identifier. A positive with a score below 0 has no
    window. Other columns are not read. An empty table, or one without anchors, gives an empty one.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("_is_anchor", F.coalesce(anchors, F.lit(False)))
    whole = staged(quantised(marked.select(id_col, label_col, vector_col), id_col, vector_col, label_col))
    own = staged(quantised(marked.where("_is_anchor").select(id_col, label_col, vector_col), id_col, vector_col, label_col).withColumn("at", F.monotonically_increasing_id()))
    ends = whole.agg(F.min("id"), F.max("id")).first()
    base = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    n = 0
    for block in blocks(own):
        w = Windows(block, positives(whole, block, n_positives), low, high, n_negatives, *ends)
        if len(w.anchor):
            narrowed(whole, block, w)
            gathered(whole, block, w).write.parquet(f"{base}/block={n}")
            n += 1
    dropped(whole, own)
    if not n:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(f"{RESULT}, block int").parquet(base).drop("block")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_sum(list_transform(list_zip(a.q, v.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
