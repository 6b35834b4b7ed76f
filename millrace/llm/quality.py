"""Quality classification by co-training.

Two classifiers see different views of a document: one the content of its text (hashed words and pairs of words, and the
text's shape), one its page's metadata. Each is a naive Bayes model, first fitted on the labelled documents; then, for
some rounds, each also learns from what the other is confident about among all unlabelled documents. A view is confident
in a class where, on labelled documents that neither was fitted on, so confident predictions of that class are wrong at
most PART of the times that the class is wrong at large; so each class has a bar of its own, and a view that cannot tell
a class teaches nothing of it. Each view's log-odds are calibrated on the same documents, and the calibrated views are
added up to one score for every document.

Features are computed once per document and kept as small numbers. All fitting is counting: a round is two passes in
which each task sums up a table of fixed size, and these tables are all that reaches the driver, however many documents
there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, dropped, parts, staged, table
from millrace.llm.near_dedup import STEP, mixed, word_hashes
from millrace.session import map_arrow

ROUNDS = 2
#: A view teaches the other where it errs this part as often as the class's share would.
PART = 0.25
SMOOTHING = 1.0
BINS = 16
SOURCES, LANGS = 512, 64
#: Buckets of words and of pairs of words.
WORDS = 1 << 16
#: Labelled documents that are learned from and calibrated on at most, by a hash of their ids: so many ids and labels go
#: to every task, at every size of the input.
LABELS = 1 << 16
#: Steps of a log-odds value in the calibration's counts, and their range either way.
STEPS, RANGE = 4, 20
#: The known labels' place in the tables of a pass, and the folds: learned from, calibrated on, held out.
KNOWN, CALIBRATED, HELD_OUT = (0, 1), 3, 2


def binned(share: Column) -> Column:
    """A share from 0 to 1 in BINS bins, finer towards 0, where most of what matters lies."""
    return F.least(F.floor(F.sqrt(F.greatest(share, F.lit(0.0))) * BINS), F.lit(BINS - 1)).cast("int")


def text_view(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.char_length(text), F.lit(1))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.split(text, "\n")
    n = F.greatest(F.size(words), F.lit(1))
    return [
        binned(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\x09-\x0D\x20.,;:'\"()?!-]")) / chars),
        binned(F.regexp_count(text, F.lit(r"[!?]{2}|[.,]{3}")) / n),
        binned(F.regexp_count(text, F.lit(r"\p{Lu}")) / chars),
        binned(F.regexp_count(text, F.lit(r"\p{N}")) / chars),
        binned(1 - F.size(F.array_distinct(words)) / n),
        binned(1 - F.size(F.array_distinct(lines)) / F.size(lines)),
        binned(chars / n / 64),
        F.least(F.floor(F.log2(n)), F.lit(BINS - 1)).cast("int"),
    ]


def meta_view(lang: Column, source: Column, n_chars: Column) -> list[Column]:
    hashed = lambda c, size: F.pmod(F.xxhash64(F.coalesce(c, F.lit("\0"))), F.lit(size)).cast("int")
    length = F.when(F.coalesce(n_chars, F.lit(0)) > 0, F.least(F.floor(2 * F.log2(n_chars)), F.lit(63)).cast("int")).otherwise(0)
    return [hashed(lang, LANGS), hashed(source, SOURCES), length]


#: Values that each feature may have.
TEXT_SIZES, META_SIZES = [BINS] * 8, [LANGS, SOURCES, 64]
#: The models: values of all features of each.
SIZES = {"shape": sum(TEXT_SIZES), "words": WORDS, "meta": sum(META_SIZES)}
#: The models that make up a view.
VIEWS = {"text": ("shape", "words"), "meta": ("meta",)}


def numbered(features: list[Column], sizes: list[int]) -> Column:
    """All features of a view as numbers of one range."""
    return F.array(*[f + sum(sizes[:k]) for k, f in enumerate(features)])


def with_words(rows: DataFrame) -> DataFrame:
    """rows (text, id, ...) with `words`, the distinct buckets of words and of neighbouring pairs in two bytes each, in place
    of the text."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 0):
            of, h = word_hashes([(t or "").encode("utf-8") for t in b.column(0).to_pylist()])
            pair = of[1:] == of[:-1]
            both = mixed(h[:-1][pair] * STEP + h[1:][pair])
            keys = np.unique(np.concatenate([of, of[1:][pair]]) * WORDS + (np.concatenate([h, both]) >> np.uint64(48)).astype(np.int64))
            at = 2 * np.searchsorted(keys, np.arange(len(b) + 1) * WORDS).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(at), pa.py_buffer((keys % WORDS).astype("<u2"))])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(1, b.num_columns)), words], names=[*kept, "words"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return map_arrow(rows.select("text", *kept), run, f"{types}, words binary")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists, or of values in two bytes each."""
    if pa.types.is_binary(column.type):
        values = [np.frombuffer(x, "<u2") for x in column.to_pylist()]
        return np.repeat(np.arange(len(values)), [len(x) for x in values]), np.concatenate([np.zeros(0, "<u2"), *values])
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), column.flatten().to_numpy()


class Model:
    """Log-odds of all features, and each view's calibration: the logit of good is a + b . (scores of its models)."""

    def __init__(self, odds: dict[str, np.ndarray]):
        self.odds = odds
        self.curve: dict[str, np.ndarray] = {}
        self.bars: dict[str, tuple[float, float]] = {}

    def scores(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """For each view rows x models, in steps. Words count by their mean: a long text is no surer for its length."""
        out = {}
        for view, models in VIEWS.items():
            cols = []
            for m in models:
                of, value = flat(batch.column(batch.schema.names.index(m)))
                total = np.bincount(of, self.odds[m][value], len(batch))
                cols.append(10 * total / np.maximum(1, np.bincount(of, minlength=len(batch))) if m == "words" else total)
            out[view] = np.clip(np.round(np.stack(cols, 1) * STEPS), -RANGE * STEPS, RANGE * STEPS)
        return out

    def logits(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {v: self.curve[v][0] + x @ self.curve[v][1:] for v, x in self.scores(batch).items()}

    def lessons(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """What each view says of each row: 1 good, 0 bad, -1 not confident."""
        return {v: np.where(x >= self.bars[v][1], 1, np.where(x <= self.bars[v][0], 0, -1)) for v, x in self.logits(batch).items()}


def summed(rows: DataFrame, count) -> dict[tuple, int]:
    """Sums over all rows of what count(batch) gives for each batch, arrays by name: each task adds up its own and sends
    what is not 0. The arrays have fixed sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in parts(batches, names.index("words")):
            for name, x in count(b).items():
                sums[name] = sums.get(name, 0) + x
        for name, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(x[at].astype(np.int64))], names=["name", "at", "n"])

    names = rows.columns
    found = map_arrow(rows, run, "name string, at long, n long").groupBy("name", "at").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    return dict(zip(zip(found["name"], found["at"], strict=True), found["n"], strict=True))


def known_labels(batch: pa.RecordBatch, folds: tuple[int, ...]) -> np.ndarray:
    """1 good, 0 bad, -1 neither or of another fold."""
    quality = batch.column(batch.schema.names.index("quality")).fill_null(-1).to_numpy(zero_copy_only=False)
    fold = batch.column(batch.schema.names.index("fold")).to_numpy()
    return np.where(np.isin(fold, folds), quality, -1)


def fitted(rows: DataFrame, teacher: Model | None) -> Model:
    """Each model's log-odds from the labelled documents to learn from and, where there is a teacher, from what the other
    view is confident about among the unlabelled ones."""

    def count(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        known, any_label = known_labels(batch, KNOWN), batch.column(batch.schema.names.index("quality")).is_valid().to_numpy(zero_copy_only=False)
        lessons = teacher.lessons(batch) if teacher else {}
        out = {}
        for view, models in VIEWS.items():
            label = known
            for other in lessons:
                if other != view:
                    label = np.where(any_label, known, lessons[other])
                    out[f"lessons of {other}"] = np.bincount(label[~any_label] + 1, minlength=3)
            for m in models:
                of, value = flat(batch.column(batch.schema.names.index(m)))
                for c in (0, 1):
                    out[f"{m} {c}"] = np.bincount(value[label[of] == c], minlength=SIZES[m])
        return out

    found = summed(rows, count)
    odds = {}
    for models in VIEWS.values():
        for m in models:
            of = [np.full(SIZES[m], SMOOTHING) for _ in (0, 1)]
            for c in (0, 1):
                at = [(k, n) for (name, k), n in found.items() if name == f"{m} {c}"]
                np.add.at(of[c], [k for k, _ in at], [n for _, n in at])
            log_share = [np.zeros(SIZES[m]), np.zeros(SIZES[m])]
            begin = 0
            for size in {"shape": TEXT_SIZES, "words": [WORDS], "meta": META_SIZES}[m]:
                for c in (0, 1):
                    own = of[c][begin : begin + size]
                    log_share[c][begin : begin + size] = np.log(own / own.sum())
                begin += size
            odds[m] = log_share[1] - log_share[0]
    model = Model(odds)
    model.taught = {v: (found.get((f"lessons of {v}", 1), 0), found.get((f"lessons of {v}", 2), 0)) for v in VIEWS}
    return model


def calibrated(rows: DataFrame, model: Model) -> None:
    """Sets the model's curves and bars, by the labelled documents of the fold that nothing is learned from."""
    width = 2 * RANGE * STEPS + 1

    def count(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        label, out = known_labels(batch, (CALIBRATED,)), {}
        for view, x in model.scores(batch).items():
            cell = np.zeros(len(label), np.int64)
            for k in range(x.shape[1]):
                cell = cell * width + (x[:, k] + RANGE * STEPS).astype(np.int64)
            for c in (0, 1):
                out[f"{view} {c}"] = np.bincount(cell[label == c], minlength=width ** x.shape[1])
        return out

    found = summed(rows, count)
    for view, models in VIEWS.items():
        points = [(k, c, n) for c in (0, 1) for (name, k), n in found.items() if name == f"{view} {c}"]
        cell, y, n = (np.array([p[k] for p in points], np.int64) for k in range(3))
        x = np.stack([cell // width ** (len(models) - 1 - k) % width - RANGE * STEPS for k in range(len(models))], 1).astype(float) if points else np.zeros((0, len(models)))
        model.curve[view] = logistic(x, y, n)
        model.bars[view] = bars(model.curve[view][0] + x @ model.curve[view][1:], y, n)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(offset, slopes) of the logistic curve through points x with labels y, each n times, by Newton's method. A small
    ridge keeps the slopes finite where the classes part cleanly; a slope is not below 0."""
    good, bad = n[y == 1].sum(), n[y == 0].sum()
    w = np.zeros(1 + x.shape[1])
    w[0] = math.log((good + 1) / (bad + 1))
    if not good or not bad:
        return w
    ones = np.concatenate([np.ones((len(x), 1)), x], 1)
    ridge = np.array([1e-6] + [1.0] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(ones @ w, -40, 40)))
        slope = ones.T @ (n * (y - p)) - ridge * w
        step = np.linalg.solve((ones * (n * p * (1 - p))[:, None]).T @ ones + np.diag(ridge + 1e-9), slope)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    w[1:] = np.maximum(w[1:], 0)
    return w


def bars(logit: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(most for bad, least for good): the bars that let most through on their side of one half and err as seldom as PART
    asks, each with one more error than was seen. Infinite where there is none."""
    out = []
    for c, sign in ((0, 1.0), (1, -1.0)):
        order = np.argsort(sign * logit, kind="stable")
        of, right, all_ = logit[order], np.cumsum(np.where(y == c, n, 0)[order]), np.cumsum(n[order])
        share = n[y == c].sum() / max(1, n.sum())
        last = np.append(of[1:] != of[:-1], True)[: len(of)]  # rows of one logit pass together
        fine = np.flatnonzero(last & (all_ - right + 1 <= PART * (1 - share) * (all_ + 1)))
        out.append(float(of[fine[-1]]) if len(fine) else -sign * math.inf)
    return min(out[0], -1e-9), max(out[1], 1e-9)


def co_trained(rows: DataFrame, rounds: int) -> Model:
    """The model after these rounds, over rows as scored() stages them."""
    model = None
    for _ in range(rounds + 1):
        model = fitted(rows, model)
        calibrated(rows, model)
    return model


def scored(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, threshold: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, score (calibrated probability of good quality), p_text, p_meta, held_out, kept.

    docs has text, lang, source and n_chars, labels has the id and quality (0, 1 or null: not labelled; of several
    labels for one id the lowest counts; of more than LABELS labelled ids those with the least hashes are used, the others
    are documents without a label). Documents whose crc32(id as text) mod 4 is 2 are held out of everything, and
    those with 3 are for calibration alone. Nulls in any column are values of their own; an empty text is a text without
    words; a null id is scored and never labelled. Without labels all scores are one half. Repeated rows are scored
    each; other columns are not read. An empty table gives an empty one.
    """
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4, F.lit(0)).cast("int")
    features = docs.select(
        F.col("text"),
        F.col(id_col).alias("id"),
        fold.alias("fold"),
        numbered(text_view(F.col("text")), TEXT_SIZES).alias("shape"),
        numbered(meta_view(F.col("lang"), F.col("source"), F.col("n_chars")), META_SIZES).alias("meta"),
    )
    truth = labels.where("quality IN (0, 1)").groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    truth = staged(truth.orderBy(F.xxhash64("id"), "id").limit(LABELS))
    rows = staged(with_words(features).join(F.broadcast(truth), "id", "left"))
    dropped(truth)
    model = co_trained(rows.drop("id"), rounds)
    n = rows.where((F.col("fold") == CALIBRATED) & F.col("quality").isNotNull()).agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    prior = math.log((n[1] + 1) / (n[0] - n[1] + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, names.index("words")):
            x = model.logits(b)
            p = [1 / (1 + np.exp(-np.clip(v, -40, 40))) for v in (x["text"] + x["meta"] - prior, x["text"], x["meta"])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(b.column(1).to_numpy() == HELD_OUT), *map(pa.array, p)], names=["id", "held_out", "score", "p_text", "p_meta"])

    names = ["id", "fold", *SIZES]
    kind = rows.schema["id"].dataType.simpleString()
    out = map_arrow(rows.select(*names), run, f"id {kind}, held_out boolean, score double, p_text double, p_meta double")
    return out.select(F.col("id").alias(id_col), "score", "p_text", "p_meta", "held_out", (F.col("score") >= threshold).alias("kept"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
