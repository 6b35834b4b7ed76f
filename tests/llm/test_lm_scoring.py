"""Context-tree weighting against its definition, worked out context by context; sums of chances; chunks and pieces."""

import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import lm_scoring as lm



def fold():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))


def learned(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def lower(text) -> bytes:
    return (text or "").encode().lower()


class Tree:
    """All decisions seen, by context (nearest byte first) and bits so far: the weighted probability by recursion."""

    def __init__(self, texts: list[bytes], depth: int):
        self.depth, self.seen, self.children, self.kept = depth, defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for t in texts:
            data = b"\xff" * depth + t + b"\xff"
            for k in range(depth, len(data)):
                context = data[k - depth : k][::-1]
                for j in range(8):
                    bits, bit = data[k] >> (8 - j) | 1 << j, data[k] >> (7 - j) & 1
                    for d in range(depth + 1):
                        self.seen[context[:d], bits][bit] += 1
                        if d < depth:
                            self.children[context[:d], bits].add(context[: d + 1])

    def estimate(self, node) -> float:
        a, b = self.seen.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node) -> float:
        if node not in self.kept:
            context, bits = node
            own = self.estimate(node)
            if len(context) < self.depth:
                below = sum(self.weighted((c, bits)) for c in self.children.get(node, ()))
                top = max(own, below)
                own = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(below - top))
            self.kept[node] = own
        return self.kept[node]

    def chance(self, context: bytes, bits: int, bit: int, d: int = 0) -> float:
        node = context[:d], bits
        seen = self.seen.get(node, (0, 0))
        own = (seen[bit] + 0.5) / (sum(seen) + 1)
        if d == self.depth:
            return own
        w = math.exp(math.log(0.5) + self.estimate(node) - self.weighted(node))
        return w * own + (1 - w) * self.chance(context, bits, bit, d + 1)

    def score(self, text: bytes) -> float:
        data, total = b"\xff" * self.depth + text + b"\xff", 0.0
        for k in range(self.depth, len(data)):
            context = data[k - self.depth : k][::-1]
            total += sum(math.log10(self.chance(context, data[k] >> (8 - j) | 1 << j, data[k] >> (7 - j) & 1)) for j in range(8))
        return total


def wanted(rows: list[tuple], depth: int) -> list[tuple]:
    tokens = lambda t: [*lower(t).split(), b""]
    counts = Counter(w for i, t in rows if learned(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    tree = Tree([lower(t) for i, t in rows if learned(i)], depth)
    base = lambda t: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))
    return [(i, not learned(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base(t), 6), round(tree.score(lower(t)), 5), len(lower(t))) for i, t in rows]


def got(docs, depth: int = lm.DEPTH) -> list[tuple]:
    rows = lm.scored(docs, fold(), depth).collect()
    assert all(abs(r.bits_per_byte + r.score * math.log2(10) / (r.n_bytes + 1)) < 1e-9 for r in rows)
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5), r.n_bytes) for r in rows]


def same(a: list[tuple], b: list[tuple]) -> None:
    a, b = sorted(a, key=repr), sorted(b, key=repr)
    assert [(*r[:5], r[7]) for r in a] == [(*r[:5], r[7]) for r in b]
    for x, y in zip(a, b, strict=True):
        # the sums that go between the levels are rounded to whole parts of 1 / UNIT
        assert abs(x[5] - y[5]) < 1e-5 and abs(x[6] - y[6]) < 2e-4 * (1 + abs(y[6])), (x, y)


def prose(n: int) -> list[tuple]:
    return [(k, brute.prose(k % 37, 20 + k % 30) + ("\n" if k % 3 else "  \tÉ ß") * (k % 4)) for k in range(n)]


@pytest.mark.parametrize("depth", [2, 3, 4, 6])
def test_against_the_definition(spark, depth):
    rows = [*prose(60), (100, "never seen: ÿþ 日本"), (101, None), (102, ""), (103, "ZZZZ" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(got(docs, depth), wanted(rows, depth))


def test_odd_documents(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").where("length(text) < 3000 OR text IS NULL").collect()]
    same(got(odd.where("length(text) < 3000 OR text IS NULL")), wanted(rows, lm.DEPTH))
    assert lm.scored(odd, fold()).count() == odd.count()
    assert lm.scored(none, fold()).count() == 0


def test_chunks_pieces_and_partitions_change_nothing(spark, monkeypatch):
    rows = [*prose(200), (500, brute.prose(3, 4000)), (501, "x" * 7000), (502, " " * 3000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = got(docs.repartition(1))
    for name, small in (("CHUNK", 3000), ("PIECE", 700), ("PART", 1000), ("LISTED", 500), ("FAN", 3)):
        monkeypatch.setattr(lm, name, small)
    same(got(docs.repartition(5)), whole)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    for r in lm.scored(docs, F.lit(False)).collect():
        assert r.held_out and r.n_known == r.train_tokens == r.base_score == 0
        assert math.isclose(r.score, -8 * (r.n_bytes + 1) * math.log10(2)) and math.isclose(r.bits_per_byte, 8)


def test_chances_of_all_bytes_after_a_context_add_up_to_one(spark):
    rows = prose(40)
    data = [b"\xff" * 3 + lower(t) + b"\xff" for _, t in rows]
    keys, n = np.unique(lm.grams(data, 3)[1], return_counts=True)
    seen = dict(zip(keys.tolist(), n.tolist(), strict=True))
    contexts = sorted({k >> 8 for k in seen})[::40] + [0x010203]
    every = sorted(set(seen) | {c << 8 | b for c in contexts for b in range(256)})
    pair = lambda k: int(lm.OF_PAIR[k >> 16])
    rows = [(b, np.array([k for k in every if pair(k) == b], np.uint64).tobytes(), np.array([seen.get(k, 0) for k in every if pair(k) == b], np.int64).tobytes()) for b in sorted({pair(k) for k in every})]
    model = lm.trained(spark.createDataFrame(rows, "bucket int, keys binary, counts binary"), 3).collect()
    value = {k: v for r in model for k, v in zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["values"], float).tolist(), strict=True)}
    for c in contexts:
        assert abs(sum(10 ** value[c << 8 | b] for b in range(256)) - 1) < 1e-9


def test_log_gamma():
    x = np.concatenate([np.arange(1, 60) / 2, [1e3, 12345.5, 1e9]])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lm.op12_lm_scoring(spark, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out != learned(r.doc_id) and r.n_tokens == len(lower(texts[r.doc_id]).split()) + 1 for r in rows)
    unseen = [r for r in rows if r.held_out]
    # held out texts in fewer bits than bytes by their counts alone take
    seen = Counter(b for i, t in texts.items() if learned(i) for b in lower(t))
    plain = sum(-math.log2((seen[b] + 1) / (sum(seen.values()) + 256)) for i, t in texts.items() if not learned(i) for b in lower(t))
    assert sum(-r.score for r in unseen) * math.log2(10) < 0.7 * plain
    again = {r.doc_id: r.score for r in lm.op12_lm_scoring(spark, sf).collect()}
    assert all(math.isclose(r.score, again[r.doc_id], rel_tol=1e-12) for r in rows)
