import math
import random

import duckdb
import numpy as np

from touchline.llm import op11_hard_negatives as op


def brute(rows, every=100, p=5, k=5, percent=80):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * c) for c in v)))
    kept = sorted(set(kept))
    out = []
    for a, al, q in kept:
        if a % every:
            continue
        ranked = sorted((-sum(map(int.__mul__, q, x)), i, label) for i, label, x in kept if i != a)
        for ps, pos, _ in [r for r in ranked if r[2] == al][:p]:
            found = [r for r in ranked if r[2] != al and percent * -ps <= 100 * -r[0] <= 100 * -ps][:k]
            out += [(a, pos, n, i, -ps, -s) for n, (s, i, _) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, v, label, 0, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, x int, leaf string")
    return sorted(map(tuple, op.mine(df, **k).collect()))


def clustered(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(int(i), [float(np.float32(c)) for c in centres[rng.integers(6)] * rng.uniform(0.5, 1.5) + rng.normal(size=dim) * spread], int(rng.integers(4))) for i in range(n)]


def test_matches_brute_force(spark):
    rows = clustered(600, 5, 1)
    want = brute(rows, every=20)
    assert len(want) > 300
    assert run(spark, rows, anchor_every=20) == want
    assert run(spark, rows, anchor_every=20, sample=256, cell=50, block=40) == want


def test_ties_copies_and_hot_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) / 4 for _ in range(3)], rng.randint(0, 2)) for i in range(250)]
    rows += [(1000 + i, [0.25, 0.5, 0.25], i % 3) for i in range(200)]
    rows += rows[:40] + [(rows[20][0], [0.5, 0.5, 0.5], 1)] + [(3000, [0.25, 0.5, 0.25], 2), (3100, [0.25, 0.5, 0.25], 2)]
    want = brute(rows, every=20)
    assert run(spark, rows, anchor_every=20) == want
    assert run(spark, rows, anchor_every=20, sample=128, cell=30, block=7) == want


def test_edge_cases(spark):
    rows = clustered(60, 3, 3)
    odd = [(None, [1.0, 1.0, 1.0], 1), (61, None, 1), (62, [1.0, None, 1.0], 1), (63, [float("nan"), 0.0, 1.0], 1), (64, [float("inf"), 0.0, 1.0], 1), (65, [1.0, 1.0, 1.0], None), (200, [-1.0, -1.0, -1.0], 9), (300, [1e6, -1e6, 1e6], 2), (301, [1e6, 1e6, 1e6], 2), (302, [1e6, 1e5, 1e6], 3)]
    assert run(spark, rows + odd, anchor_every=10) == brute(rows + odd, every=10)
    assert run(spark, []) == [] and run(spark, odd[:6]) == [] and run(spark, [(100, [1.0], 2)]) == []
    assert run(spark, [(1, [1.0], 2), (2, [1.0], 3)]) == []


def test_large_components_stay_exact():
    rng = np.random.default_rng(4)
    a, b = rng.integers(-(1 << 28), 1 << 28, (5, 8)), rng.integers(-(1 << 28), 1 << 28, (6, 8))
    assert op.scores(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]


def test_bounds_hold_for_every_leaf():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (500, 6))
    limit = float((x**2).sum(1).max())
    points = op.augmented(x, limit)
    for sampled in (False, True):
        tree, leaf = op.grow(points[:400] if sampled else points, 16, sampled)
        leaf = tree.route(points) if sampled else leaf
        q = np.column_stack([rng.integers(-300, 300, (40, 6)), np.zeros(40)]).astype(float)
        low, high = tree.bounds(q, np.full(40, 1e-6))
        gap = np.sqrt(((q[:, None] - points) ** 2).sum(2))
        assert (low[:, leaf] <= gap + 1e-5).all() and (gap <= high[:, leaf] + 1e-5).all()


def test_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cursor = con.execute(op.ORACLES["op11_hard_negatives"])
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, op.op11_hard_negatives(spark, sf).select(*names).collect())) == sorted(cursor.fetchall())
