import math
from fractions import Fraction

import numpy as np

from touchline.llm import op12_whitening as op


def exact(rows):
    """n, S, the kept rows' integer vectors and the exact covariance, by fractions."""
    kept = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v is not None and not any(c is None or not math.isfinite(c) for c in v)]
    dim = max(len(x) for _, x in kept)
    kept = [(i, x + (0,) * (dim - len(x))) for i, x in kept]
    fit = sorted({x for _, x in kept})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    cov = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3) for j in range(dim)] for i in range(dim)]
    return n, sums, kept, fit, cov


def check(spark, rows, components=4):
    df = spark.createDataFrame([(i, v, 0, "a") for i, v in rows], "vec_id long, embedding array<float>, x int, n string")
    got = op.whiten(df).collect()
    n, sums, kept, fit, cov = exact(rows)
    wide = np.array([[float(c) for c in r] for r in cov])
    trace = float(sum(cov[i][i] for i in range(len(cov))))
    values, axes = np.linalg.eigh(wide)
    count = min(components, int((values > 1e-13 * max(values.max(), 1e-300)).sum()))
    assert len(got) == len(kept) * count
    by = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4 and 1 <= r.component <= count
        assert math.isclose(r.explained, values[-r.component] / trace, rel_tol=1e-9)
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    for i, x in kept:
        y = [n * c - s for c, s in zip(x, sums, strict=True)]
        want = np.array([c / n for c in y]) @ axes[:, ::-1][:, :count] / np.sqrt(values[::-1][:count])
        mine = by[(i, sum(c * c for c in y))]
        for k in range(count):
            assert any(math.isclose(abs(w), abs(want[k]), rel_tol=1e-6, abs_tol=1e-8) for w in mine[k + 1])
    return got


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim))
    return [(int(i), [float(np.float32(c)) for c in rng.normal(size=dim) @ mix + 3]) for i in range(n)]


def test_matches_exact_fractions(spark):
    got = check(spark, vectors(300, 6, 1))
    signs = {r.component: np.sign(r.whitened) for r in got if r.vec_id == 0}
    assert len(signs) == 4


def test_whitened_rows_have_identity_covariance(spark):
    rows = vectors(500, 8, 2)
    got = op.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas().pivot(index="vec_id", columns="component", values="whitened")
    assert np.allclose(np.cov(got.to_numpy().T, bias=True), np.eye(4), atol=1e-9)


def test_copies_edge_rows_and_shapes(spark):
    rows = vectors(40, 3, 3)
    rows += [(100 + k, rows[5][1]) for k in range(30)] + rows[:5]
    rows += [(None, [1.0, 2.0, 3.0]), (200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0]), (203, [1.0, float("-inf"), 2.0]), (204, [2.5]), (205, [-0.0, 0.001, -0.001])]
    check(spark, rows)
    for few in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert op.whiten(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect() == []
    flat = [(i, [float(i), 1.0, 2.0 * i]) for i in range(9)]  # one axis only
    check(spark, flat)


def test_model_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(vectors(400, 5, 4), "vec_id long, embedding array<float>")
    first, *others = (sorted(map(tuple, op.whiten(d).select("vec_id", "component", "deviation", "whitened", "explained").collect())) for d in (df.coalesce(1), df.repartition(7), df.orderBy("embedding")))
    assert all(x == first for x in others)


def test_sliced_products_are_exact():
    rng = np.random.default_rng(5)
    for bits in (10, 30, 50, 61):
        y = rng.integers(-(1 << bits), 1 << bits, (300, 4))
        count = op.limb_count(1 << bits)
        total = op.sliced_products(y, count)
        got = [[sum(int(total[s, i, j]) << (op.LIMB * s) for s in range(len(total))) for j in range(4)] for i in range(4)]
        big = y.astype(object)
        assert got == (big.T @ big).tolist()
    wide = rng.integers(-(1 << 40), 1 << 40, (50, 3)).astype(object) * (1 << 40)
    total = op.sliced_products(wide, op.limb_count(1 << 80))
    assert [[sum(int(total[s, i, j]) << (op.LIMB * s) for s in range(len(total))) for j in range(3)] for i in range(3)] == (wide.T @ wide).tolist()
