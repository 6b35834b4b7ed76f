"""Hard negatives against a plain search, with ties by the thousand, wide and narrow scores, several blocks and odd rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives as hn

KIND = "vec_id long, embedding array<float>, label int, id long, q string, at long, window int"


def wanted(rows: list[tuple], every: int = 10, n_positives: int = 5, n_negatives: int = 10) -> Counter:
    sound = [(i, x, lab) for i, x, lab in rows if i is not None and lab is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    sound = [(i, [math.floor(256 * c) for c in x], lab) for i, x, lab in sound]
    out = Counter()
    for i, a, lab in sound:
        if i % every:
            continue
        order = sorted((-sum(p * q for p, q in zip(a, x, strict=False)), j, other) for j, x, other in sound if j != i)
        for p, j, _ in [r for r in order if r[2] == lab][:n_positives]:
            near = [r for r in order if r[2] != lab and 30 * -p <= 100 * -r[0] <= 90 * -p][:n_negatives]
            out.update((i, j, k + 1, r[1], -p, -r[0]) for k, r in enumerate(near))
    return out


def mined(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], KIND).repartition(parts)
    return Counter(map(tuple, hn.mined(df, F.col("vec_id") % 10 == 0, **more).collect()))


def vectors(seed: int, n: int, dims: int, scale: float, labels: int = 3) -> list[tuple]:
    r = random.Random(seed)
    return [(k, [float(f"{r.gauss(0.3, 1) * scale:.4g}") for _ in range(dims)], r.randrange(labels)) for k in range(n)]


def as_float(rows):
    import numpy as np

    return [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x], lab) for i, x, lab in rows]


@pytest.mark.parametrize(("dims", "scale"), [(8, 0.2), (3, 0.005), (5, 40.0), (16, 3e4)])
def test_against_all_pairs(spark, dims, scale):
    rows = as_float(vectors(dims, 300, dims, scale))
    assert mined(spark, rows) == wanted(rows)


def test_ties_go_by_identifier_over_several_digits(spark):
    """Two thirds of all rows have one vector, and identifiers are far apart."""
    rows = [(k * 7_919 * (1 + k % 3), [1.0, 0.5], k % 3) if k % 3 else (k * 10, [0.9 + k % 5 / 10, 0.5], k % 2) for k in range(2400)]
    rows = as_float(rows)
    some = {r[0]: r for r in rows}
    rows = list(some.values())
    few = [r for r in rows if r[0] % 10 or r[0] % 400 == 0]
    assert mined(spark, few, 7) == wanted(few)


def test_blocks_of_anchors_and_narrow_digits_change_nothing(spark, monkeypatch):
    rows = as_float(vectors(5, 400, 6, 0.4))
    whole = mined(spark, rows)
    monkeypatch.setattr(hn, "ANCHORS", 7)
    monkeypatch.setattr(hn, "DIGIT", 3)
    monkeypatch.setattr(hn, "CELLS", 64)
    assert mined(spark, rows) == whole == wanted(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = as_float(vectors(9, 120, 4, 0.5))
    rows += [(None, [1.0] * 4, 1), (1000, None, 1), (1010, [1.0, None, 1.0, 1.0], 1), (1020, [nan] * 4, 1), (1030, [1.0, inf, 0.0, 0.0], 2), (1040, [-inf] * 4, 2), (1050, [1.0] * 4, None)]
    rows += [(2000, [], 1), (2010, [0.5], 0), (2011, [0.25, 0.5], 1), (2020, [0.5] * 9, 2), (-30, [0.5] * 4, 0), (-31, [0.25] * 4, 1)]
    rows += [rows[3], rows[10], rows[10], (20, [0.5, 0.5, 0.1, 0.1], 2)]
    assert mined(spark, rows) == wanted(rows)


def test_a_row_repeated_often(spark):
    rows = as_float([(0, [1.0, 0.0], 0), (1, [1.0, 0.25], 0), *[(5, [0.5, 0.5], 1)] * 500, (3, [0.5, 0.5], 1), (8, [0.5, 0.125], 1)])
    assert mined(spark, rows) == wanted(rows)


def test_numbers_beyond_doubles_are_64_bit_integers(spark):
    rows = as_float([(0, [3e6, 1.0], 0), (1, [3e6, 2.0], 0), *[(k, [9e5 + 100 * k, float(k)], 1) for k in range(2, 40) if k % 10]])
    assert mined(spark, rows) == wanted(rows)


def test_no_rows_and_no_anchors(spark):
    none = spark.createDataFrame([], KIND)
    assert hn.mined(none, F.lit(True)).count() == 0
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == Counter()
    assert mined(spark, [(10, [1.0], 0), (2, [1.0], 1)]) == Counter()  # an anchor without a positive
    assert mined(spark, [(10, [1.0], 0), (11, [-1.0], 0), (2, [1.0], 1)]) == Counter()  # a positive below 0


def test_a_task_sends_no_more_cells_than_rows_are_wanted(spark):
    """Each task's share of a window's histogram ends where its own count reaches what is wanted."""
    rows = as_float(vectors(3, 3000, 4, 0.5, 2))
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], KIND).repartition(2)
    whole = hn.quantised(df)
    block = hn.Block(*map(list, zip(*[(r.id, r.label, r.q) for r in whole.where("id % 500 = 0").collect()], strict=True)))
    w = hn.Windows(block, hn.positives(whole, block, 5), 30, 90, 10, 0, 2999)
    sent = []
    real = hn.map_arrow
    hn.map_arrow = lambda df, run, kind: sent.append(real(df, run, kind)) or sent[-1]
    try:
        hn.counted(whole, block, w, *next(iter(w.passes())))
    finally:
        hn.map_arrow = real
    assert 0 < sent[0].count() <= 2 * 10 * len(w.anchor)
