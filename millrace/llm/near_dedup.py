"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set of word shingles is sketched in rounds: in each of the first COORDINATES rounds every shingle is thrown
into a random bin with a random value, and a bin keeps the least value of the first round that reached it; a further
COORDINATES rounds fill one given bin each. So every coordinate of every sketch is filled, for sets of one shingle as
for long ones, after a few rounds in most cases, and the share of equal coordinates of two sketches is concentrated
about the similarity of the sets as if each coordinate were an independent sample.

Coordinates are grouped in bands; documents that agree on a band share a bucket. Documents with the same set are one
class from the start. In each bucket all are compared with the smallest identifier, on their full sets, and joined: a
large group of near copies costs a comparison for each member, not for each pair. Where a bucket still holds several
components after that, links between them are looked for among the documents of such buckets: blocks of a cluster
compare longer sketches inside tasks, and only pairs of different components whose sketches leave a link possible are
compared on their full sets. So no link between components is lost but with a probability below MISS, and no group's
pairs are ever rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import dropped, parts, staged, table
from millrace.session import map_arrow, ship

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
COORDINATES = 320
#: For the second look at documents whose buckets hold several components: a byte for each coordinate.
LONG = 1280
#: Documents of a cluster, the buckets with one smallest identifier, that are compared with as many others in one task.
BLOCK = 1024
#: Chance of missing a pair that is just similar enough, for the bands and for the longer sketches.
MISS = 1e-5
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

U = np.uint64
_random = np.random.Generator(np.random.PCG64(20_240_601))
LETTERS = _random.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
LETTERS[65:91] = LETTERS[97:123]
ROUND_SEEDS = _random.integers(0, 1 << 63, 2 * LONG, dtype=U)
STEP, WORD_STEP, SHORT_STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA24BAED4963EE407)
SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


@lru_cache(maxsize=4)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(STEP), -1, 1 << 64))
    up, down = np.full(size, STEP), np.full(size, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts in parts of some CHUNK bytes; a longer one is cut between words."""
    at, some, size = [], [], 0
    for k, t in enumerate(texts):
        begin = 0
        while begin < len(t):
            end = len(t)
            if end - begin > CHUNK and (cut := SEPARATOR.search(t, begin + CHUNK)):
                end = cut.start() + 1
            if some and size + end - begin > CHUNK:
                yield at, some
                at, some, size = [], [], 0
            at.append(k)
            some.append(t[begin:end])
            size += end - begin
            begin = end
    if some:
        yield at, some


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all words in order, A-Z as a-z."""
    of, hashes = [], []
    for at, some in pieces(texts):
        data = np.frombuffer(b" " + b" ".join(some) + b" ", np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        end = np.flatnonzero(~space[:-1] & space[1:])
        up, down = powers(1 << max(0, len(data) - 1).bit_length())
        sums = np.cumsum(LETTERS[data] * up[: len(data)], dtype=U)
        hashes.append(mixed((sums[end] - sums[begin - 1]) * down[begin]))
        ends = np.cumsum([len(s) + 1 for s in some])
        of.append(np.array(at, np.int64)[np.searchsorted(ends, begin - 1, "right")])
    if not of:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(of), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: runs of `words` words; with fewer, all words as one."""
    of, w = word_hashes(texts)
    count = np.bincount(of, minlength=len(texts))
    first = np.cumsum(count) - count
    out = [np.zeros(0, U)] * len(texts)
    if len(w) >= words:
        runs = len(w) - words + 1
        h = np.zeros(runs, U)
        for j in range(words):
            h = h * WORD_STEP + w[j : j + runs]
        h = mixed(h)
    for k in np.flatnonzero(count >= words):
        out[k] = np.unique(h[first[k] : first[k] + count[k] - words + 1])
    for k in np.flatnonzero((count > 0) & (count < words)):
        h1 = U(count[k])
        with np.errstate(over="ignore"):
            for x in w[first[k] : first[k] + count[k]]:
                h1 = h1 * SHORT_STEP + x
        out[k] = mixed(np.array([h1], U))
    return out


def sketches(sets: list[np.ndarray], size: int = COORDINATES) -> np.ndarray:
    """The sketches of non-empty sets (sets x size), no coordinate empty. A value holds its round first, so a later
    round never displaces an earlier one, and rounds after a sketch is full change nothing."""
    sketch = np.full(len(sets) * size, EMPTY, U)
    x = np.concatenate(sets) if sets else np.zeros(0, U)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * size):
        h = mixed(x ^ ROUND_SEEDS[i])
        place = ((h >> U(40)) * U(size) >> U(24)).astype(np.int64) if i < size else i - size
        np.minimum.at(sketch, of * size + place, (U(i) << U(40)) | (h & U((1 << 40) - 1)))
        if i < 6 or i % 4 == 0:
            open_ = (sketch.reshape(-1, size) == EMPTY).any(1)
            if not open_.all():
                some = open_[of]
                x, of = x[some], of[some]
            if not len(x):
                break
    return sketch.reshape(-1, size)


def rows_of(percent: int) -> int:
    """Rows of a band: as many as keep the chance that a pair at the threshold shares no band below MISS."""
    miss = lambda r: (1 - (percent / 100) ** r) ** (COORDINATES // r)
    return max([1, *(r for r in range(1, 17) if miss(r) <= MISS)])


def least_matches(percent: int, size: int) -> int:
    """Equal coordinates that a pair at the threshold has but with a chance of MISS."""
    p, chance, n = percent / 100, 0.0, 0
    term = size * np.log(1 - p)  # logarithm of the chance of n equal coordinates
    while chance + np.exp(term) < MISS:
        chance += np.exp(term)
        term += np.log((size - n) / (n + 1) * p / (1 - p))
        n += 1
    return n


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A bucket for each band; the band's number is part of it."""
    bands = sketch.shape[1] // rows
    h = np.arange(1, bands + 1, dtype=U)[None, :] * STEP
    of_band = sketch[:, : bands * rows].reshape(-1, bands, rows)
    for j in range(rows):
        h = mixed(h * WORD_STEP + of_band[:, :, j])
    return h.view(np.int64)


def sketched(docs: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, class_hash, bands) of whole texts; without words: 0 and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            sets = shingle_sets([(t or "").encode("utf-8") for t in part.column(1).to_pylist()])
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = dict(zip(full, band_keys(sketches([sets[k] for k in full]), rows), strict=True)) if full else {}
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([keys.get(k) for k in range(len(sets))], pa.list_(pa.int64())),
                ],
                names=["id", "n_shingles", "class_hash", "bands"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_shingles long, class_hash binary, bands array<long>")


def full_sets(texts: DataFrame) -> DataFrame:
    """(id, shingles) of (id, text), shingles as sorted distinct 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            sets = [s.view(np.int64) for s in shingle_sets([(t or "").encode("utf-8") for t in part.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return map_arrow(texts, run, f"id {texts.schema['id'].dataType.simpleString()}, shingles array<long>")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each id of links (a, b) reaches. Labels go along links and then along labels,
    until none changes; each round is written to the shared folder, and only a count comes to the driver."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct())
    after = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")))
    while True:
        before, labels = after, after.select("id", "label")
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        closer = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("beyond"))
        after = staged(closer.join(jump, "label", "left").select("id", "old", F.least("label", "beyond").alias("label")))
        dropped(before)
        if not after.where("label < old").limit(1).count():
            dropped(both)
            return after.select("id", "label")


def with_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) with the labels of both ends, as label_a and label_b, where these differ."""
    both = pairs.join(labels.select(F.col("id").alias("a"), F.col("label").alias("label_a")), "a")
    return both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("label_b")), "b").where("label_a <> label_b")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a stage whose full sets are as similar as asked for. The sets of documents in no pair are left out
    first; the others are dealt out alike at every size of the input."""
    need = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = sets.join(need, "id", "left_semi")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")).hint("merge"), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")).hint("merge"), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def joined(labels: DataFrame, candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """labels (id, label) after all links among the candidates (a, b), in rounds. In each round a document b compares the
    smallest of its candidates that are in another component still, four times as many as in the round before; links join
    components, and a candidate that they make needless is never compared. No candidate of two components is left out."""
    left, at_once = candidates, 1
    while True:
        nth = F.row_number().over(Window.partitionBy("b").orderBy("a"))
        open_ = staged(with_labels(left, labels).select("a", "b", nth.alias("nth")))
        now = staged(open_.where(F.col("nth") <= at_once).select("a", "b"))
        if not now.limit(1).count():
            dropped(open_, now)
            return labels
        links = staged(linked(now, sets, percent))
        left, at_once = open_.where(F.col("nth") > at_once).select("a", "b"), 4 * at_once
        if not links.limit(1).count():
            continue
        lower = components(with_labels(links, labels).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
        labels = staged(labels.join(lower.select(F.col("id").alias("label"), F.col("label").alias("lower")), "label", "left").select("id", F.coalesce("lower", "label").alias("label")))
        dropped(now, links)


def long_sketches(sets: DataFrame) -> DataFrame:
    """(id, n, sketch): LONG coordinates of a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                some = [np.asarray(x, np.int64).view(U) for x in batch.column(1).slice(begin, 256).to_pylist()]
                got = (mixed(sketches(some, LONG)) & U(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, 256), pa.array([len(x) for x in some], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())], names=["id", "n", "sketch"])

    return map_arrow(sets.select("id", "shingles"), run, f"id {sets.schema['id'].dataType.simpleString()}, n long, sketch binary")


def possible(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of (cluster, id, label, n, sketch) of one cluster, with different labels, whose sizes and sketches
    leave a link possible. A cluster is dealt into blocks of some BLOCK documents. Those of its largest label, which need
    no comparison with each other, are in blocks of their own; each block of others meets every block in a task."""
    of_label = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = of_label.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    # a stage has a size, by which Spark decides whether it goes to the members; so a large cluster need not meet its row
    sizes = staged(sizes.select("cluster", F.col("top.label").alias("top"), blocks(F.col("all") - F.col("top.n")).alias("others"), blocks(F.col("top.n")).alias("tops")))
    placed = members.join(sizes, "cluster").withColumn("at", F.xxhash64("id"))
    block = F.when(F.col("label") == F.col("top"), F.col("others") + F.pmod("at", F.col("tops"))).otherwise(F.pmod("at", F.col("others"))).cast("int")
    placed = placed.withColumn("block", block)
    last = F.when(F.col("block") < F.col("others"), F.col("others") + F.col("tops")).otherwise(F.col("others")) - 1
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = placed.select("cluster", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "label", "n", "sketch")
    short = 256
    least_short, least_long = least_matches(percent, short), least_matches(percent, LONG)
    kind = members.schema["id"].dataType.simpleString()

    def compare(table_: pa.Table) -> pa.Table:
        n, label = table_.column("n").to_numpy(), table_.column("label").to_numpy()
        block, ids = table_.column("block").to_numpy(), table_.column("id").to_numpy()
        one, two = table_.column("one")[0].as_py(), table_.column("two")[0].as_py()
        order = np.argsort(n, kind="stable")
        n, label, block, ids = n[order], label[order], block[order], ids[order]
        sketch = np.frombuffer(b"".join(table_.column("sketch").to_pylist()), np.uint8).reshape(-1, LONG)[order]
        begins = np.ascontiguousarray(sketch[:, :short])
        a, b = [], []
        for k in range(len(n) - 1):
            end = int(np.searchsorted(n, n[k] * 100 // percent, "right"))  # the sizes of a link
            near = np.flatnonzero((label[k + 1 : end] != label[k]) & ((block[k + 1 : end] != block[k]) | (one == two))) + k + 1
            near = near[np.count_nonzero(begins[near] == begins[k], axis=1) >= least_short]
            near = near[np.count_nonzero(sketch[near] == sketch[k], axis=1) >= least_long]
            a.append(np.minimum(ids[near], ids[k]))
            b.append(np.maximum(ids[near], ids[k]))
        empty = ids[:0]
        return pa.table({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})

    ship(members.sparkSession)
    # dealt by blocks: without this the placement by cluster would do for the grouping, and one task have all of a cluster
    return dealt.repartition("cluster", "one", "two").groupBy("cluster", "one", "two").applyInArrow(compare, f"a {kind}, b {kind}")


def near_groups(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id (an integer), n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and are linked with nothing. A null id is linked with nothing, has no
    component and is kept. Rows that repeat an id are documents under that id: with equal texts they are one, with
    others they are linked by their own texts. Other columns of docs are not read. An empty table gives an empty one.
    """
    sketch = staged(sketched(docs, rows_of(percent), id_col, text_col))
    own = sketch.where(F.col("id").isNotNull() & F.col("class_hash").isNotNull())
    classes = staged(own.groupBy("class_hash").agg(F.min(F.struct("id", "n_shingles", "bands")).alias("r")).select("class_hash", F.col("r.id").alias("id"), "r.n_shingles", "r.bands"))

    postings = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    hubs = postings.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    # buckets with several members; the others are done
    shared = staged(postings.join(hubs.select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "key"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labels = staged(shared.select("id", F.col("id").alias("label")).distinct())
    sets = staged(full_sets(texts.join(labels.select("id").hint("merge"), "id", "left_semi")))

    near_size = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))  # noqa: E731  else no link is possible
    star = shared.where((F.col("id") != F.col("hub")) & near_size(F.col("n"), F.col("hub_n")))
    labels = joined(labels, star.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), sets, percent)

    # buckets in which different components are left; those with one smallest identifier are looked at together
    member = shared.join(labels, "id").select("key", "id", "hub", "label")
    open_ = member.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
    member = staged(member.join(open_, "key").select(F.col("hub").alias("cluster"), "id", "label").distinct())
    sketches_ = long_sketches(sets.join(member.select("id").distinct().hint("merge"), "id", "left_semi"))
    members = staged(member.join(sketches_, "id"))
    labels = joined(labels, staged(possible(members, percent).distinct()), sets, percent)
    dropped(shared, sets, member, members)

    of_class = classes.join(labels, "id", "left").select("class_hash", F.coalesce("label", "id").alias("component"))
    out = sketch.select("id", "n_shingles", "class_hash").join(of_class, "class_hash", "left")
    component: Column = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), percent=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * n_both >= 85 * (x.n_shingles + y.n_shingles - n_both)
), two AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS low FROM n UNION SELECT two.a, reach.low FROM reach JOIN two ON two.b = reach.doc_id)
SELECT n.doc_id, n_shingles, min(low) AS component_id, n.doc_id = min(low) AS kept FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n_shingles
"""
