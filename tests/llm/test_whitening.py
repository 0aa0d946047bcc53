"""Bit-sliced whitening against exact integers and plain numpy."""

import math
import random

import numpy as np
import pytest

from memjobs.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, whitened string, x string"


def brute(vectors):
    xs = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, xs)))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    centre = np.array(fit, dtype=float) - np.array([s / n for s in sums])
    values, basis = np.linalg.eigh(centre.T @ centre / n)
    return xs, n, sums, values[::-1], basis[:, ::-1], centre


def test_products_are_exact_for_any_range():
    rng = random.Random(3)
    for top, rows in ((3, 70), (1 << 20, 130), ((1 << 63) - 1, 9), (0, 5)):
        x = np.array([[rng.randint(-top - (top > 9), top) for _ in range(5)] for _ in range(rows)], dtype=np.int64)
        x[:, 2] = -7
        s, p = W.bit_sliced_products(x)
        o = x.astype(object)
        assert list(s) == list(o.sum(axis=0))
        assert np.array_equal(p, np.triu(o.T @ o))


def test_whitened_rows_equal_plain_arithmetic(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 7)) * [3, 2.5, 2, 1.5, 0.6, 0.4, 0.1] + rng.normal(size=7)
    vectors = [list(map(float, v)) for v in base] + [list(map(float, base[3]))] * 30 + [[-0.0, 0.0, -0.001, 1.0, -1.0, 2.0, 0.5]]
    odd = [None, [None] + [0.0] * 6, [float("nan")] * 7, [float("inf")] + [0.0] * 6, [1.0, 2.0], []]
    rows = [(i, v, "a", "b") for i, v in enumerate(vectors + odd)] + [(None, vectors[0], None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/t/embeddings.parquet")
    got = W.query(spark, f"file://{tmp_path}/t").collect()
    xs, n, sums, values, basis, centre = brute(vectors)
    assert len(got) == 4 * (len(vectors) + 1) and {r.n for r in got} == {n}
    assert {r.vec_id for r in got} == {None, *range(len(vectors))}
    of = {(r.vec_id, r.component): r for r in got}
    for k in range(4):
        z = (np.array(xs) - np.array([s / n for s in sums])) @ basis[:, k] / math.sqrt(values[k])
        mine = np.array([of[i, k + 1].whitened for i in range(len(vectors))])
        assert min(np.abs(mine - z).max(), np.abs(mine + z).max()) < 1e-9
        assert of[0, k + 1].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
    for i, x in enumerate(xs):
        assert of[i, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
    assert {r.identity_error for r in got}.pop() < 1e-9


def test_few_rows_and_no_spread(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], "", ""), (2, [0.5, 0.25], "", "")], SCHEMA)
    model = W.fit_whitening(one)
    assert (model.n, model.explained, model.identity_error) == (1, [0.0, 0.0], 0.0)
    out = W.whiten(one, model).collect()
    assert [(r.vec_id, list(r.whitened), int(r.deviation), r.x) for r in out] == [(1, [0.0, 0.0], 0, ""), (2, [0.0, 0.0], 0, "")]
    two = spark.createDataFrame([(1, [0.5, 0.25, 0.0], "", ""), (2, [0.0, 0.25, 0.5], "", "")], SCHEMA)
    model = W.fit_whitening(two)
    assert model.explained == pytest.approx([1.0, 0.0, 0.0], abs=1e-12) and model.identity_error < 1e-12
    assert sorted(round(r.whitened[0]) for r in W.whiten(two, model).collect()) == [-1, 1]


def test_huge_entries_stay_exact(spark):
    vectors = [[1e17, 0.5], [1e17, -0.5], [-1e17, 3.0]]
    df = spark.createDataFrame([(i, v, "", "") for i, v in enumerate(vectors)], SCHEMA)
    xs, n, sums, *_ = brute(vectors)
    xs = [[min(max(c, -(1 << 63)), (1 << 63) - 1) for c in x] for x in xs]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    model = W.fit_whitening(df)
    assert model.sums == sums and model.n == 3
    sizes = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs]
    assert [W.deviations(np.array([x]), n, sums)[0] for x in xs] == sizes
