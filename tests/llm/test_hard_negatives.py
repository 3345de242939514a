"""Hard negatives against a walk over all pairs; Strassen against plain products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from provloom.llm.hard_negatives import Heaps, mine_negatives, strassen

ROWS = "vec_id long, label int, embedding array<double>, score string"


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 100), (65, 65, 65), (70, 3, 41), (0, 5, 3), (200, 63, 301)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    a, b = rng.integers(-(2**25), 2**25, (m, k)), rng.integers(-(2**25), 2**25, (k, n))
    assert (strassen(a, b) == a @ b).all() and (strassen(a, b, leaf=1) == a @ b).all()


def test_heaps_keep_the_first_by_score_then_id():
    rng = np.random.default_rng(2)
    heaps, seen = Heaps(3, 4), [[] for _ in range(3)]
    for k in range(7):
        score, ids = rng.integers(-3, 3, (3, 9)), np.sort(rng.integers(0, 20, 9))
        numbers = np.arange(9) + 9 * k
        heaps.add(score, ids, numbers)
        for o in range(3):
            seen[o] += [(-s, i, n) for s, i, n in zip(score[o].tolist(), ids.tolist(), numbers.tolist())]
    for o in range(3):
        assert list(zip((-heaps.score[o]).tolist(), heaps.id[o].tolist(), heaps.number[o].tolist())) == sorted(seen[o])[:4]


def brute(rows, every):
    good = [(i, n, l, [math.floor(256 * c) for c in v]) for n, (i, l, v, _) in enumerate(rows) if i is not None and l is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, n, l, v in good:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m, k) for j, m, k, w in good if m != n and len(w) == len(v)]
        for p, j, _, _ in sorted(x for x in scored if x[3] == l)[:5]:
            fits = sorted(x for x in scored if x[3] != l and 30 * -p <= 100 * -x[0] <= 90 * -p)[:10]
            out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, every, **more):
    got = mine_negatives(spark.createDataFrame(rows, ROWS).repartition(3), F.col("vec_id") % every == 0, **more).collect()
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got)


@pytest.mark.parametrize("blocks", [(512, 2048), (7, 20)])
def test_against_all_pairs(spark, blocks):
    rng = np.random.default_rng(5)
    labels = [0 if rng.random() < 0.4 else int(rng.integers(1, 40)) for _ in range(260)]
    rows = [(k, labels[k], (rng.integers(-2, 4, 6) / 4).tolist(), "x") for k in range(260)]  # many ties
    rows += [(None, 1, [1.0] * 6, "x"), (260, None, [1.0] * 6, "x"), (270, 1, None, "x"), (280, 1, [], "x"), (290, 1, [None] * 6, "x"), (300, 1, [math.nan] * 6, "x"), (310, 0, [1.0, 1.0], "x"), (320, 0, [1.0, 0.5], "x"), (321, 2, [0.5, 0.5], "x")]
    expected = brute(rows, 10)
    assert len(expected) > 300 and mined(spark, rows, 10, anchor_block=blocks[0], candidate_block=blocks[1]) == expected


def test_copies_are_rows_of_their_own(spark):
    rows = [(10, 1, [1.0, 0.0], "x"), (10, 1, [1.0, 0.0], "x"), (11, 2, [0.5, 0.5], "x"), (11, 2, [0.5, 0.5], "x")]
    # Each copy of 10 has the other as its positive, and both copies of 11 in its window.
    assert mined(spark, rows, 10) == sorted([(10, 10, r, 11, 65536, 32768) for r in (1, 2)] * 2) == brute(rows, 10)


def test_no_rows_no_anchor_no_positive_no_negative(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, 1, [1.0], "x"), (2, 1, [1.0], "x")], 10) == []
    assert mined(spark, [(10, 1, [1.0], "x"), (11, 2, [1.0], "x")], 10) == []
    assert mined(spark, [(10, 1, [1.0], "x"), (11, 1, [1.0], "x"), (12, 2, [1.0], "x")], 10) == []
