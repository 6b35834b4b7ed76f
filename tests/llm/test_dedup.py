"""Exact and near duplicates against all pairs."""

import random
from collections import defaultdict

import brute
import pytest

from millrace.llm import exact_dedup, near_dedup


def test_exact_groups(odd):
    groups = defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        groups[brute.SPACES.sub(" ", r.text or "")].append(r.doc_id)
    want = []
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        kept_one = False
        for i in ids:
            kept = i == least and not kept_one
            kept_one |= kept
            want.append((i, least, len(ids), kept, brute.sha(text)))
    assert sorted(map(repr, map(tuple, exact_dedup.exact_groups(odd).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("hot", [256, 2])
def test_exact_groups_rest_on_the_comparison_of_texts(spark, monkeypatch, hot):
    """Texts of one beginning and one mark are told apart by their content alone, in one part and over many."""
    monkeypatch.setattr(exact_dedup, "mark", lambda text: exact_dedup.F.lit(1).cast("long"))
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    begin = "the same beginning of all texts "
    rows = [(k, begin + "abcd"[k * 7 % 11 % 4] * (1 + k % 2)) for k in range(90)] + [(None, begin + "a"), (None, begin + "only null ids")] * 2
    want, least = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        least.setdefault(t, i)
    for k, (i, t) in enumerate(rows):
        want.append((i, least[t], sum(t == u for _, u in rows), i == least[t] and (i, t) not in rows[:k], brute.sha(t)))
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_distinct_documents_keep_all_columns(odd):
    got = exact_dedup.distinct_documents(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert len(rows) == len({brute.SPACES.sub(" ", r.text or "") for r in odd.collect()})
    assert {r["_row"] for r in rows} == {"y"}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_groups(odd, percent):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    root = brute.near(rows, percent)
    want = sorted(repr((i, len(brute.shingles(t)), None if i is None else root[i], i is None or root[i] == i)) for i, t in rows)
    assert sorted(map(repr, map(tuple, near_dedup.near_groups(odd, percent).collect()))) == want


def test_near_groups_of_a_crowd_of_variants(spark):
    """Many copies that differ from each other: links beyond the smallest identifier of a bucket are found too."""
    r = random.Random(5)
    rows = []
    for family in range(4):
        words = brute.prose(100 + family, 120).split(" ")
        for _ in range(90):
            some = list(words)
            for _ in range(r.randrange(6)):
                some[r.randrange(len(some))] = f"v{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(some)))
    r.shuffle(rows)
    root = brute.near(rows, 85)
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == root


def test_empty_tables(none):
    assert exact_dedup.exact_groups(none).count() == 0
    assert near_dedup.near_groups(none).count() == 0
