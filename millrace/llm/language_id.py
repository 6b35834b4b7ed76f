"""Language identification by mixture inference.

Each language is a distribution over hashed character trigrams, counted over all documents to learn from. A document
is taken as a mixture: expectation-maximisation estimates the proportions of a set of languages from the likelihoods
of the document's trigrams. The set begins with the likeliest single language and gains one language after another as
long as the log-likelihood gains more than a penalty. The largest proportion is the prediction.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import parts, table
from millrace.session import map_arrow

BUCKETS = 1 << 16
SMOOTHING = 0.05
ROUNDS = 8
#: A further language must gain this much for each doubling of the trigrams, and this share of a nat for each of them.
GAIN_LOG, GAIN_EACH = 3.0, 0.02
#: Bytes of documents, characters of one document, and trigrams times languages that are worked on at once.
BYTES, CHARS, CELLS = 1 << 19, 1 << 18, 1 << 18
#: Languages a model may have: it goes to all tasks as BUCKETS numbers for each.
LANGUAGES = 256
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each trigram around a letter. Anything but letters counts as one space."""
    # each text stands between spaces, so no trigram spans two
    chars = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(s) + 1 for s in texts])
    of = np.concatenate([of[:1], of])
    is_letter = letters()[chars]
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]  # a space after a letter stays, others go
    x, of, middle = np.where(is_letter, chars, 32)[keep], of[keep], is_letter[keep]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = x[:-2] * np.uint32(0x9E3779B1) ^ (x[1:-1] * np.uint32(0x85EBCA77) + np.uint32(0x165667B1)) ^ (x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(3)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    middle = middle[1:-1]
    return of[1:-1][middle], (h >> np.uint32(16)).astype(np.int64)[middle]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the trigrams of a part of the documents, sorted by text and bucket. Several texts are
    short together; a long one stands alone and is read in pieces of CHARS characters, two characters in both of two
    pieces, into BUCKETS counts."""
    if len(texts) == 1:
        text, sums = (texts[0] or "").lower(), np.zeros(BUCKETS, np.int64)
        for begin in range(0, len(text), CHARS):
            sums += np.bincount(hashed([text[max(0, begin - 2) : begin + CHARS]])[1], minlength=BUCKETS)
        bucket = np.flatnonzero(sums)
        return np.zeros(len(bucket), np.int64), bucket, sums[bucket]
    of, bucket = hashed([(t or "").lower() for t in texts])
    key, n = np.unique(of * BUCKETS + bucket, return_counts=True)
    return key // BUCKETS, key % BUCKETS, n


def held_out(id_col: str) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def to_learn_from(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(~held_out(id_col) & F.col(id_col).isNotNull())


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and their distributions over buckets (BUCKETS x languages). Counts cover all rows with a language; a
    task sums its own first, and BUCKETS numbers for each language reach the driver. More than LANGUAGES different
    languages are an error: such a column names something else. Repeated rows count each; null texts count nothing; an
    empty table, or one without languages, gives no languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in parts(batches, 0, BYTES):
            of, bucket, n = trigrams(b.column(0).to_pylist())
            langs = b.column(1).to_pylist()
            names = sorted(set(langs))
            index = np.array([names.index(x) for x in langs], np.int64)[of]
            for k, name in enumerate(names):
                own = index == k
                sums[name] = sums.get(name, 0) + np.bincount(bucket[own], n[own], BUCKETS)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            at = at if len(at) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counted = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    some = [r["lang"] for r in counted.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(some) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} different values")
    counted = map_arrow(counted, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted.column("lang").to_pylist()))
    at = np.array([names.index(x) for x in counted.column("lang").to_pylist()], np.int64) if names else np.zeros(0, np.int64)
    sums = np.zeros((BUCKETS, len(names)))
    sums[counted.column("bucket").to_numpy(), at] = counted.column("n").to_numpy()
    return names, (sums + SMOOTHING) / (sums.sum(0) + SMOOTHING * BUCKETS)


def fit(start: np.ndarray, n: np.ndarray, p: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages in `among` (texts x languages) and log-likelihoods, by expectation-maximisation."""
    length = np.diff(np.append(start, len(n)))
    total = np.add.reduceat(n, start)
    share = among / among.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        mix = np.einsum("ij,ij->i", p, np.repeat(share, length, 0))
        share = share * np.add.reduceat(p * (n / mix)[:, None], start) / total[:, None]
    mix = np.einsum("ij,ij->i", p, np.repeat(share, length, 0))
    return share, np.add.reduceat(n * np.log(mix), start)


def infer(start: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts whose trigrams begin at `start`: the language, the set chosen (texts x languages), the score, and the
    mixture's log-likelihood."""
    n = n.astype(float)
    alone = np.add.reduceat(n[:, None] * np.log(p), start)
    total = np.add.reduceat(n, start)
    texts, langs = alone.shape
    penalty = GAIN_LOG * np.log2(1 + total) + GAIN_EACH * total
    best = alone.argmax(1)
    chosen = np.zeros((texts, langs), bool)
    chosen[np.arange(texts), best] = True
    share, now = chosen.astype(float), alone.max(1)
    length = np.diff(np.append(start, len(n)))
    open_ = np.arange(texts)
    while langs > 1 and len(open_):
        rows = np.repeat(np.isin(np.arange(texts), open_), length)
        n_open, p_open = n[rows], p[rows]
        start_open = np.concatenate([[0], np.cumsum(length[open_])[:-1]])
        # of the languages that could join a text's set, the best so far alone is kept
        got, more, shares = np.full(len(open_), -np.inf), np.zeros(len(open_), np.int64), np.zeros((len(open_), langs))
        for k in range(langs):
            among = chosen[open_].copy()
            new = ~among[:, k]
            if new.any():
                among[:, k] = True
                used = among.any(0)  # columns that no text has in its set are left out
                part, likely = fit(start_open, n_open, p_open[:, used], among[:, used].astype(float))
                better = new & (likely > got)
                got[better], more[better] = likely[better], k
                whole = np.zeros((len(open_), langs))
                whole[:, used] = part
                shares[better] = whole[better]
        gain = got - now[open_]
        yes = gain > penalty[open_]
        won = open_[yes]
        chosen[won, more[yes]] = True
        share[won] = shares[yes]
        now[won] += gain[yes]
        open_ = won[chosen[won].sum(1) < langs]
    if langs > 1:
        order = np.partition(alone, -2, axis=1)
        sure = 1 / (1 + np.exp(-np.clip(order[:, -1] - order[:, -2], 0, 50)))
    else:
        sure = np.ones(texts)
    top = share.argmax(1)
    return top, chosen, share.max(1) * sure, now


def predicted(texts: list[str | None], names: list[str], p: np.ndarray) -> tuple[list[str], np.ndarray, list[list[str]], np.ndarray]:
    """Language, score, set of languages, and gain of each text of a part. The gain is the log-likelihood of the text's
    mixture over that of trigrams that are all alike, in nats for a trigram."""
    of, bucket, n = trigrams(texts)
    lang, score, sets, gain = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts], np.zeros(len(texts))
    at = 0
    while at < len(of) and names:  # whole texts, some CELLS cells at once
        end = min(len(of), at + CELLS // len(names))
        if end < len(of):
            end = max(int(np.searchsorted(of, of[end], "left")), int(np.searchsorted(of, of[at], "right")))
        here, start = np.unique(of[at:end], return_index=True)
        top, chosen, sure, likely = infer(start, n[at:end], p[bucket[at:end]])
        score[here] = sure
        gain[here] = likely / np.add.reduceat(n[at:end], start) + np.log(BUCKETS)
        for k, t, c in zip(here, top, chosen, strict=True):
            lang[k], sets[k] = names[t], [names[j] for j in np.flatnonzero(c)]
        at = end
    return lang, score, sets, gain


def predict(docs: DataFrame, names: list[str], p: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score, languages (the set chosen). Only the text is looked at; a null
    text, one without letters, or a model without languages gives `und` and 0; repeated rows are predicted each; an empty
    table gives an empty one. A plain map over whole texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast((names, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1, BYTES):
            lang, score, sets, _ = predicted(b.column(1).to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), pa.array(sets, pa.list_(pa.string()))], names=[id_col, "lang_pred", "score", "languages"])

    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {kind}, lang_pred string, score double, languages array<string>")


def accepted(docs: DataFrame, names: list[str], p: np.ndarray, languages: Collection[str] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are in a language: predicted as one of `languages` (null: any that
    was learned), by a mixture that explains the text better than trigrams drawn all alike do. So rows without text
    or letters go, and those in letters that no learned language is made of. Rows of any other columns stay as they are,
    repeated ones each; an empty table gives an empty one. A plain map."""
    model = docs.sparkSession.sparkContext.broadcast((names, p))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, at, BYTES):
            lang, _, _, gain = predicted(b.column(at).to_pylist(), *model.value)
            yield b.filter(pa.array([x != UNKNOWN and g > 0 and (languages is None or x in languages) for x, g in zip(lang, gain, strict=True)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the documents that are not held out and predicts all: id, held_out, lang_pred, score, languages.

    Null ids are not held out and not learned from; null languages are not learned from. Repeated rows are learned
    from and predicted each; other columns are not read. An empty table gives an empty one.
    """
    names, p = learn(to_learn_from(docs, id_col), text_col, lang_col)
    got = predict(docs, names, p, id_col, text_col)
    return got.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "languages")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).drop("languages")
