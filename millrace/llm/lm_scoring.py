"""Language-model scores by context-tree weighting over bytes.

A byte is decomposed into eight binary decisions. For each decision and each context of 0 to `depth` bytes before it, a
Krichevsky-Trofimov estimator has seen the decisions of the documents to learn from; at each context the estimator is
weighed against the contexts one byte longer by how well either coded those decisions, so all depths are mixed at once and
none is chosen. The code length of a byte under the mixture depends on the byte and the `depth` bytes before it alone, so
the model is a table of such grams and their probabilities, one for each that occurs.

That table grows with the corpus and is never sent to all tasks. Texts are dealt into chunks of bounded size; a chunk
lists its distinct grams and words with their counts, in buckets; sums over all chunks, a bounded number of lists at a
time, train the model; each chunk gets the values of what it listed, and is scored with that slice of the model. A bucket
of grams has all those with some pairs of last two bytes of context, so that all deeper contexts of a tree are in one
place; what is above these, contexts of no and one byte, is a table of 256 x 255 decisions, however large the corpus is.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import dropped, grouped, parts, staged, table
from millrace.llm.near_dedup import SEPARATOR
from millrace.session import map_arrow, ship

#: Bytes of context; a gram is a number of 63 bits at most.
DEPTH = 5
#: Bytes of text that share a slice of the model; of a piece of a long text; and that are looked at in one go.
CHUNK, PIECE, PART = 32 << 20, 1 << 20, 1 << 20
#: Buckets of grams, by the two nearest bytes of context, and of words.
PAIRS, WORDS = 512, 1024
#: Lists of a bucket that a task adds up, and grams that it has before it adds them up.
FAN, LISTED = 64, 1 << 21
#: The byte that stands for the end of a text, and for what is before its beginning: no text in UTF-8 has it.
EDGE = 0xFF
#: The end as a word.
END = bytes([EDGE])
#: The bucket of each pair of bytes.
OF_PAIR = (np.arange(1 << 16) * 40503 % (1 << 16) * PAIRS >> 16).astype(np.int64)
#: Logarithms are added up over tasks in whole parts of 1 / UNIT, so that their order does not matter.
UNIT = 4096
HALF = math.log(0.5)


def split_text(text: bytes) -> Iterator[bytes]:
    """Pieces of some PIECE bytes, cut behind white space."""
    begin = 0
    while len(text) - begin > PIECE and (cut := SEPARATOR.search(text, begin + PIECE)):
        yield text[begin : cut.end()]
        begin = cut.end()
    yield text[begin:]


def grams(bodies: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(body, gram) of all bytes of bodies but their first `depth`, which are context. A gram has the nearest byte of
    context first and the byte itself last, so that grams of like contexts are neighbours when sorted."""
    data = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint64)
    n = np.array([len(b) for b in bodies], np.int64)
    of = np.repeat(np.arange(len(bodies)), n - depth)
    key = data[depth:].copy()
    for j in range(1, min(depth, len(data)) + 1):
        key |= data[depth - j : len(data) - j] << np.uint64(8 * (depth - j + 1))
    is_text = np.ones(len(data), bool)
    for j in range(depth):
        is_text[np.cumsum(n) - n + j] = False
    return of, key[is_text[depth:]]


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order; by sorting, which is faster here than hashing."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
    return k[begin], np.add.reduceat(n, begin) if len(begin) else n


def by_bucket(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, buckets in that order) of sorted grams by bucket."""
    bucket = OF_PAIR[(key >> np.uint64(8 * (depth - 1))).astype(np.int64)]
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


class Chunk:
    """What a task knows of the chunk it is filling."""

    def __init__(self, number: int):
        self.number, self.size, self.unseen = number, 0, 0
        self.waiting: list[tuple[bool, bytes]] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.words: Counter[bytes] = Counter()

    def add(self, body: bytes, learn: bool, last: bool, depth: int) -> None:
        words = body[depth : len(body) - last].split()
        if last:
            words.append(END)
        if learn:
            self.words.update(words)
        else:
            for w in words:
                self.words[w] += 0
        self.waiting.append((learn, body))
        self.size += len(body)
        self.unseen += len(body)
        if self.unseen >= PART:
            self.look(depth)

    def look(self, depth: int) -> None:
        for learn in (True, False):
            k, n = np.unique(grams([b for x, b in self.waiting if x == learn], depth)[1], return_counts=True)
            self.keys.append(k)
            self.counts.append(n if learn else np.zeros(len(k), np.int64))
        self.waiting, self.unseen = [], 0
        if sum(map(len, self.keys)) > LISTED:
            self.put_together()

    def put_together(self) -> None:
        k, n = summed(self.keys, self.counts)
        self.keys, self.counts = [k], [n]

    def lists(self, depth: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, keys, counts) of all that the chunk has."""
        self.look(depth)
        self.put_together()
        order, bucket = by_bucket(self.keys[0], depth)
        key, n = self.keys[0][order], self.counts[0][order]
        ends = np.searchsorted(bucket, np.arange(PAIRS + 1))
        for k in np.flatnonzero(ends[1:] > ends[:-1]):
            yield int(k), key[ends[k] : ends[k + 1]].tobytes(), n[ends[k] : ends[k + 1]].astype(np.int32).tobytes()
        words: dict[int, list[bytes]] = defaultdict(list)
        for w in self.words:
            words[zlib.crc32(w) % WORDS].append(w)
        for k, some in words.items():
            yield PAIRS + k, b" ".join(some), np.array([self.words[w] for w in some], np.int32).tobytes()


def dealt(docs: DataFrame, depth: int) -> DataFrame:
    """The texts of docs (id, learn, text) in chunks. Rows with a body are pieces of a text in lower case, with `depth`
    bytes before them; rows with a bucket list what is in a chunk, and how often in documents to learn from."""
    kind = docs.schema["id"].dataType.simpleString()
    fields = ["chunk", "row", "id", "learn", "last", "body", "bucket", "keys", "counts"]
    types = [pa.int64(), pa.int64(), None, pa.bool_(), pa.bool_(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        chunk, row, id_type = Chunk(task << 32), task << 40, pa.null()

        def batch(rows: list[tuple], of: list[str]) -> pa.RecordBatch:
            columns = dict(zip(of, zip(*rows, strict=True), strict=True))
            made = [pa.array(columns[f], t or id_type) if f in columns else pa.nulls(len(rows), t or id_type) for f, t in zip(fields, types, strict=True)]
            return pa.RecordBatch.from_arrays(made, names=fields)

        def listed() -> Iterator[pa.RecordBatch]:
            lists = [(chunk.number, *x) for x in chunk.lists(depth)]
            for begin, end in grouped([len(x[2]) for x in lists], PART):
                yield batch(lists[begin:end], ["chunk", "bucket", "keys", "counts"])

        for whole in parts(batches, 2, PART):
            id_type = whole.schema.field(0).type
            pieces = []
            for at, learn, text in zip(whole.column(0), whole.column(1).to_pylist(), whole.column(2), strict=True):
                before, left = bytes([EDGE]) * depth, list(split_text(text.as_buffer().to_pybytes().lower() if text.is_valid else b""))
                for k, piece in enumerate(left):
                    last = k == len(left) - 1
                    body = before + piece + bytes([EDGE]) * last
                    before = body[len(body) - depth :]
                    chunk.add(body, learn, last, depth)
                    pieces.append((chunk.number, row, at, learn, last, body))
                    if chunk.size >= CHUNK:
                        yield from listed()
                        chunk = Chunk(chunk.number + 1)
                row += 1
            for begin, end in grouped([len(p[-1]) for p in pieces], PART):
                yield batch(pieces[begin:end], fields[:6])
        if chunk.size:
            yield from listed()

    return map_arrow(docs, run, f"chunk long, row long, id {kind}, learn boolean, last boolean, body binary, bucket int, keys binary, counts binary")


def unpacked(bucket: int, keys: bytes) -> np.ndarray | list[bytes]:
    return np.frombuffer(keys, np.uint64) if bucket < PAIRS else keys.split(b" ")


def added(lists: DataFrame, chunks: int) -> DataFrame:
    """(bucket, keys, counts) of all chunks together, as a stage: a tree in which a task adds up some FAN lists of a
    bucket."""

    def add(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        keys = [unpacked(bucket, x) for x in rows.column("keys").to_pylist()]
        counts = [np.frombuffer(x, f"i{len(x) // len(k)}").astype(np.int64) for k, x in zip(keys, rows.column("counts").to_pylist(), strict=True)]
        if bucket < PAIRS:
            k, n = summed(keys, counts)
            k, n = k.tobytes(), n.tobytes()
        else:
            sums: dict[bytes, int] = defaultdict(int)
            for some, c in zip(keys, counts, strict=True):
                for w, x in zip(some, c.tolist(), strict=True):
                    sums[w] += x
            k, n = b" ".join(sums), np.fromiter(sums.values(), np.int64, len(sums)).tobytes()
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "part": rows.column("part").slice(0, 1), "keys": pa.array([k], pa.binary()), "counts": pa.array([n], pa.binary())})

    ship(lists.sparkSession)
    n = -(-max(1, chunks) // FAN)
    rows = lists.select("bucket", F.pmod(F.xxhash64("chunk"), F.lit(n)).alias("part"), "keys", "counts")
    while True:
        sums = staged(rows.groupBy("bucket", "part").applyInArrow(add, "bucket int, part long, keys binary, counts binary"))
        if n == 1:
            return sums
        n = -(-n // FAN)
        rows = sums.withColumn("part", F.pmod("part", F.lit(n)))


def answered(lists: DataFrame, model: DataFrame, groups: int) -> DataFrame:
    """(chunk, bucket, keys, values): the lists' values in the model, of words with the words. The chunks are dealt into
    groups, each of which meets the whole model once, bucket by bucket."""

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        bucket = asked.column("bucket")[0].as_py() if len(asked) else 0
        values = []
        if len(asked):
            keys, value = (known.column(c)[0].as_py() for c in ("keys", "values"))
            keys, value = unpacked(bucket, keys), np.frombuffer(value, float)
            place = {} if bucket < PAIRS else {w: k for k, w in enumerate(keys)}
            for x in asked.column("keys").to_pylist():
                own = unpacked(bucket, x)
                at = np.searchsorted(keys, own) if bucket < PAIRS else [place[w] for w in own]
                values.append(value[at].tobytes())
        # a chunk knows its grams, and their order
        keys = pa.nulls(len(asked), pa.binary()) if bucket < PAIRS else asked.column("keys")
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "keys": keys, "values": pa.array(values, pa.binary())})

    ship(lists.sparkSession)
    asked = lists.select("chunk", "bucket", F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("part"), "keys")
    of_all = model.select(F.col("bucket").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), "keys", "values")
    return asked.groupBy("bucket", "part").cogroup(of_all.groupBy("of", "group")).applyInArrow(look_up, "chunk long, bucket int, keys binary, values binary")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function from 1/2 on: Stirling's series, for small numbers after eight steps up."""
    low = x < 8
    y = np.where(low, x + 8, x)
    s = 1 / (y * y)
    series = (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s * (1 / 1188 - s * 691 / 360360))))) / y
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    product = np.ones_like(y)
    for j in range(8):
        product *= np.where(low, x + j, 1)
    return out - np.log(product)


def log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Level:
    """The contexts of one depth: bytes after them with counts, sorted, and where the rows of the level below are here."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.n, self.of_below = key, n, np.zeros(0, np.int64)

    def above(self) -> Level:
        """The level with contexts one byte shorter: the furthest byte goes."""
        shorter = self.key >> np.uint64(16) << np.uint64(8) | self.key & np.uint64(255)
        key, at = np.unique(shorter, return_inverse=True)
        out = Level(key, np.bincount(at, self.n, len(key)))
        out.of_below = at
        return out

    def decisions(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(decision of each row, first row of each, zeros, ones) of bit k, 0 the highest."""
        node = self.key >> np.uint64(8 - k)
        first = np.append(True, node[1:] != node[:-1])[: len(node)]
        of = np.cumsum(first) - 1
        bit = (self.key >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
        n = int(first.sum())
        return of, np.flatnonzero(first), np.bincount(of[~bit], self.n[~bit], n), np.bincount(of[bit], self.n[bit], n)


def trees(key: np.ndarray, n: np.ndarray, depth: int, least: int) -> Iterator[list[tuple]]:
    """For each bit, from the deepest level to depth `least`: (decision of each gram, first row of each in the level, zeros,
    ones, logarithm of the estimate, logarithm of the weighted probability, the level)."""
    levels = [Level(key, n.astype(float))]
    for _ in range(depth - least):
        levels.append(levels[-1].above())
    for k in range(8):
        out, to_level = [], np.arange(len(key))
        for x, level in enumerate(levels):
            of, first, n0, n1 = level.decisions(k)
            estimate = log_estimate(n0, n1)
            weighted = estimate
            if x:
                to_level = level.of_below[to_level]
                parent = of[level.of_below[out[-1][1]]]
                weighted = HALF + np.logaddexp(estimate, np.bincount(parent, out[-1][5], len(first)))
            out.append((of[to_level], first, n0, n1, estimate, weighted, level))
        yield out


def shallow(sums: DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight, probability of a one) of the decisions with one byte of context (rows 0 to 255, by that byte) and none
    (row 256). A decision is numbered by a one and the bits before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in unpacked_rows(batches):
            for k, found in enumerate(trees(keys, counts, depth, 2)):
                _, first, n0, n1, _, weighted, level = found[-1]
                node = level.key[first]
                number = (node >> np.uint64(8 - k) & np.uint64((1 << k) - 1)).astype(np.int64) + (1 << k)
                at, place = np.unique((node >> np.uint64(16)).astype(np.int64) << 8 | number, return_inverse=True)
                zeros, ones = (np.bincount(place, x, len(at)).astype(np.int64) for x in (n0, n1))
                whole = np.zeros(len(at), np.int64)
                np.add.at(whole, place, np.round(weighted * UNIT).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (at, zeros, ones, whole))], names=["at", "n0", "n1", "weighted"])

    found = map_arrow(sums.where(F.col("bucket") < PAIRS).select("keys", "counts"), run, "at long, n0 long, n1 long, weighted long")
    found = found.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "weighted")])
    n0, n1, below = (np.zeros((257, 256)) for _ in range(3))
    for r in found.collect():
        n0[r.at >> 8, r.at & 255], n1[r.at >> 8, r.at & 255], below[r.at >> 8, r.at & 255] = r.n0, r.n1, r.weighted / UNIT
    weighted = np.zeros((257, 256))
    weighted[:256] = HALF + np.logaddexp(log_estimate(n0[:256], n1[:256]), below[:256])
    n0[256], n1[256], below[256] = n0.sum(0), n1.sum(0), weighted[:256].sum(0)
    weighted[256] = HALF + np.logaddexp(log_estimate(n0[256], n1[256]), below[256])
    return np.exp(HALF + log_estimate(n0, n1) - weighted), (n1 + 0.5) / (n0 + n1 + 1)


def unpacked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for keys, counts in zip(b.column(0), b.column(1), strict=True):
            yield np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.int64)


def codes(key: np.ndarray, n: np.ndarray, depth: int, weight: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The log10 probability of each gram's byte after its context."""
    total, near = np.zeros(len(key)), (key >> np.uint64(8 * depth)).astype(np.int64)
    for k, found in enumerate(trees(key, n, depth, 2)):
        bit = (key >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
        p = None
        for of, _, n0, n1, estimate, weighted, _ in found:
            own = (np.where(bit, n1[of], n0[of]) + 0.5) / (n0 + n1 + 1)[of]
            w = np.exp(HALF + estimate - weighted)[of]
            p = own if p is None else w * own + (1 - w) * p
        number = (key >> np.uint64(8 - k) & np.uint64((1 << k) - 1)).astype(np.int64) + (1 << k)
        for row in (near, 256):
            own = np.where(bit, one[row, number], 1 - one[row, number])
            p = weight[row, number] * own + (1 - weight[row, number]) * p
        total += np.log10(p)
    return total


def trained(sums: DataFrame, depth: int) -> DataFrame:
    """(bucket, keys, values): of grams the log10 probability, of words the count."""
    weight, one = shallow(sums, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (bucket, counts) in enumerate(zip(b.column(0).to_pylist(), b.column(2), strict=True)):
                n = np.frombuffer(counts.as_py(), np.int64)
                value = codes(np.frombuffer(b.column(1)[k].as_py(), np.uint64), n, depth, weight, one) if bucket < PAIRS else n.astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1), pa.array([value.tobytes()], pa.binary())], names=["bucket", "keys", "values"])

    return map_arrow(sums.select("bucket", "keys", "counts"), run, "bucket int, keys binary, values binary")


def words_learned(sums: DataFrame) -> tuple[int, int]:
    """All words of the documents to learn from, with repeats, and the distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.frombuffer(x.as_py(), np.int64) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in n]), pa.array([int((x > 0).sum()) for x in n])], names=["n", "v"])

    found = map_arrow(sums.where(F.col("bucket") >= PAIRS).select("counts"), run, "n long, v long")
    return tuple(found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first())


def of_pieces(pieces: DataFrame, slices: DataFrame, depth: int, spread: float) -> DataFrame:
    """(row, id, learn, n_tokens, n_known, n_bytes, base_score, score) of each piece, with its chunk's slice of the model."""

    def score(pieces_: pa.Table, slice_: pa.Table) -> pa.Table:
        codes_, place, count = {}, {}, []
        for bucket, keys, values in zip(slice_.column("bucket").to_pylist(), slice_.column("keys"), slice_.column("values"), strict=True):
            value = np.frombuffer(values.as_py(), float)
            if bucket < PAIRS:
                codes_[bucket] = value
            else:
                words = unpacked(bucket, keys.as_py())
                place.update(zip(words, range(len(place), len(place) + len(words)), strict=True))
                count.append(value)
        count = np.concatenate([*count, np.zeros(0)])
        base = np.log10(count + 1) - spread
        last = pieces_.column("last").to_pylist()
        bodies = pieces_.column("body")
        out = {c: np.zeros(len(pieces_), t) for c, t in (("n_tokens", np.int64), ("n_known", np.int64), ("n_bytes", np.int64), ("base_score", float), ("score", float))}
        runs = list(grouped([len(b.as_buffer()) for b in bodies], PART))
        key = distinct(np.concatenate([distinct(grams(bodies.slice(begin, end - begin).to_pylist(), depth)[1]) for begin, end in runs]))
        code = np.empty(len(key))
        code[by_bucket(key, depth)[0]] = np.concatenate([codes_[k] for k in sorted(codes_)])
        for begin, end in runs:
            some = bodies.slice(begin, end - begin).to_pylist()
            of, gram = grams(some, depth)
            own, at = np.unique(gram, return_inverse=True)
            out["score"][begin:end] = np.bincount(of, code[np.searchsorted(key, own)][at], end - begin)
            words = [body[depth:-1].split() + [END] if end_ else body[depth:].split() for body, end_ in zip(some, last[begin:end], strict=True)]
            n = np.array([len(x) for x in words])
            of = np.repeat(np.arange(end - begin), n)
            at = np.fromiter(map(place.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
            out["n_tokens"][begin:end], out["n_bytes"][begin:end] = n, [len(body) - depth - end_ for body, end_ in zip(some, last[begin:end], strict=True)]
            out["n_known"][begin:end], out["base_score"][begin:end] = np.bincount(of, count[at] > 0, end - begin), np.bincount(of, base[at], end - begin)
        return pa.table({c: pieces_.column(c) for c in ("row", "id", "learn")} | out)

    ship(pieces.sparkSession)
    kind = pieces.schema["id"].dataType.simpleString()
    return pieces.groupBy("of_chunk").cogroup(slices.groupBy("chunk")).applyInArrow(score, f"row long, id {kind}, learn boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double")


def scored(docs: DataFrame, learn: Column, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out (not learned from), n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte.

    score is the log10 probability of the whole text, A-Z in lower case, and its end; bits_per_byte the same as a code
    length (the end is a byte more). base_score is that of its words and its end, each by its count with one added. A null
    text is an empty one: its end alone. A null `learn` is not learned from. Rows that repeat an id are texts of their own.
    Other columns are not read. An empty table gives an empty one; without a text to learn from each bit is even, and
    each word's chance is 1.
    """
    if not 2 <= depth <= 6:
        raise ValueError("contexts have from 2 to 6 bytes")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text"))
    all_ = staged(dealt(rows, depth), codec="zstd")
    lists = all_.where(F.col("bucket").isNotNull()).select("chunk", "bucket", "keys", "counts")
    pieces = all_.where(F.col("body").isNotNull()).select(F.col("chunk").alias("of_chunk"), "row", "id", "learn", "last", "body")
    chunks, listed = lists.agg(F.count_distinct("chunk"), F.coalesce(F.sum(F.octet_length("counts")), F.lit(0))).first()
    sums = added(lists, chunks)
    n, v = words_learned(sums)
    model = staged(trained(sums, depth))
    # a group of chunks lists no less than there is in the model, so the model is not repeated oftener than its size allows
    size = model.agg(F.coalesce(F.sum(F.octet_length("values")), F.lit(0))).first()[0]
    slices = answered(lists, model, max(1, min(-(-chunks // FAN), (listed // 4) // max(1, size // 8))))
    found = of_pieces(pieces, slices, depth, math.log10(n + v + 1))
    found = found.groupBy("row", "id", "learn").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "n_bytes", "base_score", "score")])
    bits = -F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)
    dropped(sums)
    return found.select(F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return scored(table(spark, sf_dir, "documents"), F.coalesce(fold != 2, F.lit(True)))
