"""Language and quality on documents that nothing was learned from, and odd ones."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import language_id, near_dedup, quality

FULL = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FULL}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right > 0.95


def test_languages_of_a_mixed_text(spark):
    docs = spark.read.parquet(f"{FULL}/documents.parquet")
    names, p = language_id.learn(language_id.to_learn_from(docs))
    long = {r.lang: r.text for r in docs.where("lang IS NOT NULL AND n_chars BETWEEN 1500 AND 4000").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    one, two = sorted(long)[:2]
    _, score, sets, _ = language_id.predicted([long[one], long[one][:1500] + " " + long[two][:1500]], names, p)
    assert sets[0] == [one] and set(sets[1]) >= {one, two} and score[1] < score[0]


def test_language_of_odd_documents(odd, none):
    rows = language_id.identify(odd).collect()
    texts = odd.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    letters = sorted(repr(r.doc_id) for r in texts if any(c.isalpha() for c in r.text or ""))
    assert sorted(repr(r.doc_id) for r in rows if r.lang_pred != "und") == letters
    assert all(0 <= r.score <= 1 and (r.score == 0 if r.lang_pred == "und" else r.lang_pred in ("en", "de")) for r in rows)
    names, p = language_id.learn(language_id.to_learn_from(odd))
    kept = language_id.accepted(odd, names, p)
    gain = {r.text: language_id.predicted([r.text], names, p)[3][0] for r in texts}
    assert kept.columns == odd.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in texts if gain[r.text] > 0 and any(c.isalpha() for c in r.text or ""))
    assert language_id.identify(none).count() == 0


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet(f"{FULL}/documents.parquet")
    names, p = language_id.learn(language_id.to_learn_from(docs))
    odd = [(1, "Привет мир, как дела"), (2, "日本語のテキストです"), (3, "qzxj wvkq zzqx jjwq"), (4, "123 !!"), (5, None)]
    texts = docs.select("doc_id", "text").where("doc_id > 5")
    kept = language_id.accepted(texts.union(spark.createDataFrame(odd, "doc_id long, text string")), names, p)
    assert kept.where("doc_id <= 5").count() == 0 and kept.count() == texts.where("text RLIKE '\\\\p{L}'").count()
    only = language_id.accepted(docs, names, p, languages=["de"])
    assert 0 < only.count() < docs.count() and only.where("lang <> 'de'").count() <= 0.01 * only.count() + 2


def test_parts_of_long_texts_count_like_the_whole(monkeypatch):
    """Where a long text is cut, up to four trigrams with the cut's own spaces come in; the others are those of the whole."""
    text = "Größe und Maß " * 300
    count = lambda texts: Counter({(of, b): n for of, b, n in zip(*(x.tolist() for x in language_id.trigrams(texts)), strict=True)})
    whole = count([text])
    assert whole == Counter({k: n for k, n in count([text, "ab"]).items() if k[0] == 0})
    monkeypatch.setattr(language_id, "CHARS", 101)
    parts = count([text])
    assert not whole - parts and (parts - whole).total() <= 4 * (len(text) // 101)


def accuracy(docs, labels, rounds):
    got = quality.scored(docs, labels, rounds=rounds).join(labels, "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int")), F.count(F.lit(1))).first()
    return right, n, max(x["count"] for x in got.groupBy("quality").count().collect()) / n


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{FULL}/documents.parquet"), spark.read.parquet(f"{FULL}/labels.parquet")
    alone, _, _ = accuracy(docs, labels, 0)
    right, n, base = accuracy(docs, labels, 2)
    assert n > 50 and right > max(0.9, base) and right >= alone


def views(spark, n, labelled):
    """Documents of which the words tell the class, and the source nearly so; every `labelled`-th has a label."""
    r = random.Random(21)
    rows, truth = [], []
    for k in range(n):
        good = r.random() < 0.6
        telling = ["meadow", "river", "orchard", "harbour"] if good else ["casino", "jackpot", "bonus", "pills"]
        words = [r.choice(telling if r.random() < 0.25 else ["and", "of", "the", "to"]) for _ in range(12)]
        rows.append((k, " ".join(words), "en", f"{'good' if good == (r.random() < 0.97) else 'bad'}{r.randrange(3)}", 70))
        truth.append((k, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(truth, "doc_id long, quality int"), spark.createDataFrame([t for t in truth if t[0] % labelled == 0], "doc_id long, quality int")


def test_both_views_teach_both_classes(spark, monkeypatch):
    docs, truth, labels = views(spark, 4000, 10)
    models = []
    monkeypatch.setattr(quality, "co_trained", lambda rows, rounds, real=quality.co_trained: models.append(real(rows, rounds)) or models[-1])
    alone, n, base = accuracy(docs, truth.withColumn("quality", F.col("quality")).join(labels.select("doc_id"), "doc_id"), 0)
    got = {r: quality.scored(docs, labels, rounds=r).join(truth, "doc_id").where("held_out").agg(*[F.avg(((F.col(c) >= 0.5).cast("int") == F.col("quality")).cast("int")).alias(c) for c in ("score", "p_text", "p_meta")]).first() for r in (0, 2)}
    assert all(k > 100 for view in models[-1].taught.values() for k in view), models[-1].taught
    assert got[2].score > 0.95 and got[2].p_text >= got[0].p_text and got[2].score >= got[0].score
    assert n > 50 and alone > base


def test_counts_are_those_of_plain_loops(spark, monkeypatch):
    """The log-odds after a first fit, from a count over words and pairs written plainly here."""
    docs, truth, labels = views(spark, 300, 2)
    models = []
    monkeypatch.setattr(quality, "co_trained", lambda rows, rounds, real=quality.co_trained: models.append(real(rows, rounds)) or models[-1])
    quality.scored(docs, labels, rounds=0)
    known = {r.doc_id: r.quality for r in labels.collect()}
    sums = [np.ones(quality.WORDS), np.ones(quality.WORDS)]
    for r in docs.collect():
        if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 4 in quality.KNOWN:
            h = near_dedup.word_hashes([r.text.encode()])[1].tolist()
            pairs = [int(near_dedup.mixed(np.array([a * int(near_dedup.STEP) + b & (1 << 64) - 1], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
            for bucket in {x >> 48 for x in h + pairs}:
                sums[known[r.doc_id]][bucket] += 1
    want = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    assert np.allclose(models[-1].odds["words"], want)


def test_quality_of_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(10, 60)] + [(12, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.scored(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert len(quality.scored(odd.union(odd), labels.union(labels)).collect()) == 2 * odd.count()
    assert quality.scored(none, labels).count() == 0


def plain_mixture(counts: list[int], p: list[list[float]]) -> tuple[set[int], list[float], float]:
    """The set of languages of one text, their shares and the log-likelihood, in plain loops: one language after the other
    joins while it gains more than the penalty."""
    import math

    langs, total = range(len(p[0])), sum(counts)

    def fit(among):
        share = {k: 1 / len(among) for k in among}
        for _ in range(language_id.ROUNDS):
            got = dict.fromkeys(among, 0.0)
            for n, row in zip(counts, p, strict=True):
                mix = sum(share[k] * row[k] for k in among)
                for k in among:
                    got[k] += n * share[k] * row[k] / mix
            share = {k: x / total for k, x in got.items()}
        return share, sum(n * math.log(sum(share[k] * row[k] for k in among)) for n, row in zip(counts, p, strict=True))

    alone = [sum(n * math.log(row[k]) for n, row in zip(counts, p, strict=True)) for k in langs]
    chosen = [max(langs, key=lambda k: (alone[k], -k))]
    share, now = {chosen[0]: 1.0}, alone[chosen[0]]
    while len(chosen) < len(langs):
        tried = [(fit(sorted([*chosen, k])), k) for k in langs if k not in chosen]
        (better, likely), k = max(tried, key=lambda x: (x[0][1], -x[1]))
        if likely - now <= language_id.GAIN_LOG * math.log2(1 + total) + language_id.GAIN_EACH * total:
            break
        chosen, share, now = [*chosen, k], better, likely
    return set(chosen), [share.get(k, 0.0) for k in langs], now


def test_mixtures_are_those_of_plain_loops():
    r = np.random.Generator(np.random.PCG64(3))
    for langs in (1, 2, 5):
        n = [r.integers(1, 60, size) for size in (1, 2, 7, 40, 90)]
        p = [r.dirichlet(np.full(200, 0.2), langs).T[r.integers(0, 200, len(x))] + 1e-5 for x in n]
        start = np.cumsum([0, *map(len, n)])[:-1]
        top, chosen, _, likely = language_id.infer(start, np.concatenate(n), np.concatenate(p))
        for k in range(len(n)):
            want, share, now = plain_mixture(n[k].tolist(), p[k].tolist())
            assert set(np.flatnonzero(chosen[k])) == want and top[k] == int(np.argmax(share)) and abs(likely[k] - now) < 1e-6 * abs(now)
