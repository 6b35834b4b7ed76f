"""Ranked search against scores of all documents, with ties, repeats, frequent words, few levels and many segments."""

import math
import random
import re
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from millrace.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def wanted(docs: list[tuple], items: list[tuple], most: int = 20) -> Counter:
    """item_id, rank, doc_id and score, for lists of (id, text)."""
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for i, c, n in own:
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, i is None, i, score))
        found.sort(key=lambda r: r[:2] + (r[2] or 0,))
        out.update((item, k + 1, i, score) for k, (_, _, i, score) in enumerate(found[:most]))
    return out


def got(spark, docs, items, most: int = 20, parts: int = 3) -> Counter:
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id long, term string").repartition(parts)
    q = spark.createDataFrame([(*r, 2, "y") for r in items], "item_id long, text string, doc_id long, `rank` string")
    return Counter(map(tuple, ls.ranked(d, q, most).collect()))


def words(seed: int, n: int, many: int = 400) -> str:
    """Words of which a few are everywhere and most are rare."""
    r = random.Random(seed)
    return " ".join(f"w{int(many * r.random() ** 3)}" for _ in range(n))


DOCS = [(k, words(k, 5 + k % 90)) for k in range(400)]
ITEMS = [(k, words(1000 + k, 1 + 3 * k)) for k in range(12)]


@pytest.mark.parametrize("most", [1, 5, 20, 1000])
def test_against_all_scores(spark, most):
    assert got(spark, DOCS, ITEMS, most) == wanted(DOCS, ITEMS, most)


def test_small_segments_few_bits_and_many_levels(spark, monkeypatch):
    for name, small in (("SEGMENT", 3), ("BITS", 8), ("LAST", 30), ("SALTS", 2)):
        monkeypatch.setattr(ls, name, small)
    assert got(spark, DOCS, ITEMS) == wanted(DOCS, ITEMS)


def test_ties_go_by_doc_id(spark):
    docs = [(1000 - k, "same words here" if k % 3 else f"other words {k}") for k in range(300)]
    items = [(1, "words here same same"), (2, "Here"), (3, "words"), (4, "nothing of it"), (5, "other WORDS")]
    assert got(spark, docs, items) == wanted(docs, items)


def test_odd_rows(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [*enumerate(brute.odd_texts()), (None, "one two three"), (3, "one"), (3, None)]
    want = wanted(docs, items, 1000)
    assert got(spark, docs, items, 1000) == want
    # where ids repeat within a cut, either row may come; scores and ids are the same
    assert got(spark, docs, items, 4) == wanted(docs, items, 4)


def test_no_rows(spark):
    assert got(spark, [], ITEMS) == got(spark, DOCS, []) == got(spark, [(1, None), (2, " .,")], ITEMS) == Counter()
    assert got(spark, [(1, "a"), (2, "a")], [(1, "a")]) == wanted([(1, "a"), (2, "a")], [(1, "a")])


def test_terms():
    for t in [*brute.odd_texts(), "a-b_c'd", "Äpfel É ÉÉ 12:30 x\x00y\x7fz ~`@[{ ﬁ"]:
        assert [x.decode() for x in ls.terms_of(t)] == terms(t)


def test_frequent_words_are_not_read_where_rare_ones_decide(spark, monkeypatch):
    """An item with 20 documents that hold its rare words closes before the level of the word that all documents hold."""
    docs = [(k, "the " + (f"rare{k % 4} odd{k % 4} strange{k % 4} " * 2 if k < 100 else words(k, 8))) for k in range(2000)]
    items = [(k, f"the rare{k} odd{k} strange{k}") for k in range(4)]
    levels = []
    real = ls.closed
    monkeypatch.setattr(ls, "closed", lambda *a: levels.append(a[0].count()) or real(*a))
    assert got(spark, docs, items) == wanted(docs, items)
    assert len(levels) <= 2 and sum(levels) <= 200  # of 2,000 documents, all of which hold a word of each item


def test_many_items_with_one_frequent_word(spark):
    docs = [(k, "the " * (1 + k % 5) + words(k, 10)) for k in range(300)]
    items = [(k, "the") for k in range(30)]
    assert got(spark, docs, items, 3) == wanted(docs, items, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert ls.ranked(df, df.select(F.col("doc_id").alias("item_id"), "text").limit(0)).count() == 0
