"""Hard negatives against plain sums over all pairs."""

import math
import random

import numpy as np
import pytest

from corpusloom.llm import hardneg as H

SCHEMA = "id long, label int, vector array<float>, is_anchor boolean"


def slow(rows, positives=5, negatives=10, low=30, high=90, scale=256):
    ok = [
        (i, lab, [math.floor(scale * float(np.float32(x))) for x in v], a) for i, lab, v, a in rows
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, lab, v, _ in {(i, lab, tuple(v), a) for i, lab, v, a in ok if a}:
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w, _ in ok if j != i)
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            taken = [(-t, n) for t, n, other in scored if other != lab and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, p, r, n, -s, t) for r, (t, n) in enumerate(taken, 1)]
    return sorted(out)


def run(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as anchor", "'x' as code", "2 as a", "3 as v", "4 as q")
    return sorted(tuple(r) for r in H.hard_negatives(df, **settings).collect())


def vectors(rng, n, dims):
    return [(i, rng.choice([0, 1, 1, 2]), [rng.uniform(-1, 1) for _ in range(dims)], i % 10 == 0) for i in range(n)]


@pytest.mark.parametrize("dims,blocks", [(8, (512, 2048)), (13, (3, 16)), (1, (2, 7))])
def test_against_all_pairs(spark, dims, blocks):
    rng = random.Random(dims)
    rows = vectors(rng, 150, dims)
    rows += [(1000 + i, 2, rows[3][2], i == 0) for i in range(30)]  # one very common vector
    rows += [(2000, None, rows[0][2], True), (None, 1, rows[0][2], True), (2001, 1, None, True), (2002, 1, [None] * dims, False)]
    rows += [(2003, 1, [float("nan")] * dims, False), (2004, 1, [float("inf")] * dims, True), (2005, 1, [], False), (2006, 1, [0.5], True)]
    rows += [rows[0], rows[0], rows[5], (10, 2, rows[11][2], True)]  # repeated rows, an id with two vectors
    want = slow(rows)
    assert want and run(spark, rows, anchors_in_block=blocks[0], rows_in_block=blocks[1]) == want


def test_other_parameters(spark):
    rows = vectors(random.Random(5), 80, 16)
    assert run(spark, rows, positives=2, negatives=1000, low=-50, high=100, scale=1000) == slow(rows, 2, 1000, -50, 100, 1000)


def test_empty_and_nothing_to_ask(spark):
    rows = vectors(random.Random(6), 20, 4)
    assert run(spark, []) == []
    assert run(spark, [(i, lab, v, False) for i, lab, v, _ in rows]) == []
    assert run(spark, [(i, 1, v, a) for i, _, v, a in rows]) == []  # no other label
    assert run(spark, [(0, 1, [1.0], True), (1, 2, [1.0], False)]) == []  # no positive


def test_too_large_components(spark):
    with pytest.raises(ValueError):
        run(spark, [(0, 1, [1e30], True), (1, 2, [1.0], False)])


def test_planes_and_tables_give_the_inner_product():
    rng = np.random.default_rng(1)
    for top in (1, 127, 128, 5000):
        q, c = rng.integers(-top, top, (6, 24)), rng.integers(-top, top, (300, 24))
        c[0], c[1] = -top, top - 1
        planes = 1 + max(int(c.max()).bit_length(), int(-c.min() - 1).bit_length())
        assert (H.score(H.subset_sums(q), H.pack(c, planes)) == c @ q.T).all()
