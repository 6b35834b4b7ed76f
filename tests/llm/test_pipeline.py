"""Each stage of the pipeline against brute force over what it was given."""

from collections import Counter

import brute
import pytest

from millrace.llm import language_id

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def checked(name, given, kept, docs):
    """given and kept: rows (doc_id, text)."""
    if name == "language ID":
        model = language_id.learn(language_id.to_learn_from(docs))
        explained = {t: language_id.predicted([t], *model)[3][0] > 0 for _, t in given}
        assert sorted(map(repr, kept)) == sorted(repr(x) for x in given if any(c.isalpha() for c in x[1] or "") and explained[x[1]])
    elif name == "exact dedup":
        least = {}
        for i, t in given:
            k = brute.SPACES.sub(" ", t or "")
            least[k] = min(least.get(k, i), i, key=lambda x: (x is None, x))
        assert Counter((i, brute.SPACES.sub(" ", t or "")) for i, t in kept) == Counter((i, k) for k, i in least.items())
    elif name == "near dedup":
        root = brute.near(given, 80)
        assert sorted(map(repr, kept)) == sorted(repr(x) for x in given if x[0] is None or root[x[0]] == x[0])
    elif name == "mixing":
        assert set(kept) <= set(given) and max(Counter(kept).values(), default=0) <= 3


@pytest.mark.parametrize("table", ["odd", "none", "documents"])
def test_stages(spark, sf, request, table):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if table == "documents" else request.getfixturevalue(table)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.staged(stage(spark, docs, sf))
        if name == corpus_pipeline.STAGES[-1][0]:
            assert after.count() == docs.count()
            break
        assert after.columns == columns
        checked(name, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.doc_id, r.text) for r in after.select("doc_id", "text").collect()], docs)
        docs = after


def test_mix_of_repeated_rows_alone(spark, odd):
    """Rows that repeat an id and text come as often as the mix takes all of them, and no oftener."""
    from millrace.llm import mixing

    six = spark.createDataFrame([(7, "w " * 30, "a")] * 6 + [(k, "v " * (k % 9 + 1), "b") for k in range(100, 160)], "doc_id long, text string, source string")
    for docs in (six, odd):
        given = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix(spark, docs, "").select("doc_id", "text").collect())
        assert all(kept[x] <= 3 * given[x] for x in kept)
        size = lambda rows: sum(len(brute.WORD.findall(t or "")) * n for (_, t), n in rows.items())
        want = sum(r.taken for r in mixing.mixed(docs).collect())
        longest = max(len(brute.WORD.findall(t or "")) for _, t in given)
        assert abs(size(kept) - want) <= 2 * longest
