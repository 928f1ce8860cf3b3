import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import exact
from touchline.operators import models, scoring
from touchline.plans import catalog

SF = "/root/testdata/sf0.001"


def bits(x):
    return struct.pack(">d", x)


def values(n=3000, seed=1):
    rng = random.Random(seed)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1.5e-310, 2.0**-1022, 1e16, -1e16, 1e-300, 3.0, 1e300, -1e300, 0.1, 2.0**31, 2.0**32, 2.0**-32, math.nextafter(2.0**32, 0)]
    return odd + [rng.choice((-1, 1)) * rng.random() * 10 ** rng.randint(-20, 20) for _ in range(n)] + [rng.random() for _ in range(n)]


def test_sums_are_exact_and_do_not_depend_on_partitions(spark):
    xs = values()
    rows = [(i % 3, x) for i, x in enumerate(xs)] + [(0, None), (7, None)]
    want = {k: (sum(1 for g, x in rows if g == k and x is not None), math.fsum(x for g, x in rows if g == k and x is not None)) for k in range(3)}
    base = spark.createDataFrame(rows, "g int, x double")
    for df in (base.coalesce(1), base.repartition(7), base.orderBy(F.desc("x")).repartition(20)):
        got = {r.g: (r.n_x, r.x) for r in exact.exact_means(df, ["g"], {"x": F.col("x")}).collect()}
        assert set(got) == set(want)
        for k, (n, total) in want.items():
            assert got[k][0] == n and bits(got[k][1]) == bits(total / n)
    assert math.isnan(exact.exact_means(spark.createDataFrame([(1.0,), (float("inf"),)], "x double"), [], {"x": F.col("x")}).first().x)


def test_leaderboard_is_the_same_bit_for_bit(spark):
    base = catalog.scored(spark, SF).cache()
    boards = [sorted(map(tuple, scoring.season_leaderboard(d).collect()), key=str) for d in (base.coalesce(1), base.repartition(7), base.repartition(40, "key"), base.orderBy("brier"))]
    assert boards[0] == boards[1] == boards[2] == boards[3]
    held = [r.brier for r in base.where("model_id = 'sharpened'").select("brier").collect()]
    assert {r.model_id: r.brier for r in scoring.leaderboard(base).collect()}["sharpened"] == math.fsum(held) / len(held)


def test_quantiles_equal_numpy_to_the_last_bit(spark):
    rng = random.Random(3)
    a = values(4000, 4)
    b = [float(rng.randint(0, 3)) for _ in range(9000)] + [None, float("nan")]
    rows = [(a[i] if i < len(a) else None, b[i] if i < len(b) else None, None) for i in range(max(len(a), len(b)))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    got = exact.exact_quantiles(df, ["a", "b", "c"], [0.0, 0.025, 0.5, 0.975, 1.0])
    assert got["c"] == [None] * 5
    for name, column in (("a", a), ("b", b[:-2])):
        s = sorted(column)
        for q, x in zip([0.0, 0.025, 0.5, 0.975, 1.0], got[name], strict=True):
            p = (len(s) - 1) * q
            low, w = int(p), p - int(p)
            assert x == (s[low] if w == 0 else s[low] * (1 - w) + s[low + 1] * w)
    assert got["a"][2] == float(np.median(a))


def test_histograms_narrow_large_columns(spark, monkeypatch):
    monkeypatch.setattr(exact, "FEW", 5)
    monkeypatch.setattr(exact, "BUCKETS", 8)
    xs = values(800, 6)
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    ranks = [0, 3, 400, 801, len(xs) - 1]
    got = exact.order_statistics(df, ["x"], {"x": ranks})
    assert [got["x", r] for r in ranks] == [sorted(xs)[r] for r in ranks]


def test_half_even_equals_rounding_of_the_exact_value(spark):
    rng = random.Random(7)
    ties = [m / 2**j for m in range(-33, 34) for j in (1, 2, 3, 5, 8)] + [2.675, 1.005, 0.125, 0.375, -2.5, 1e-11, -1e-11, 450359.96, 450360.0000000001, 524287.99999999994, 900719.925, 1e15, 1e300, 5e-324, -0.0]
    xs = ties + [math.nextafter(x, d) for x in ties for d in (math.inf, -math.inf)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 8) for _ in range(3000)] + [(k + 0.5) / 1e10 for k in range(-50, 50)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 1, 2, 3, 6, 10):
        got = [r[0] for r in df.select(exact.half_even(F.col("x"), digits)).collect()]
        assert [bits(g) for g in got] == [bits(round(x, digits)) for x in xs]
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([(float("inf"),)], "x double").select(exact.half_even(F.col("x"))).collect()


def test_imputation_by_exact_figures(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=501) * 10
    df = spark.createDataFrame([(float(v) if i % 4 else None, None) for i, v in enumerate(x)], "a double, b double")
    median, mean, deviation = models.imputation(df, ["a", "b"], few=10, exactly=True)["a"]
    near = models.imputation(df, ["a", "b"])["a"]
    assert near[0] == median and np.allclose(near, (median, mean, deviation), rtol=1e-12)
    held = [float(v) for i, v in enumerate(x) if i % 4]
    filled = [float(v) if i % 4 else float(np.median(held)) for i, v in enumerate(x)]
    assert median == float(np.median(held)) and mean == math.fsum(filled) / 501
    assert math.isclose(deviation, float(np.std(filled)), rel_tol=1e-14)
    assert models.imputation(df, ["b"])["b"] == (0.0, 0.0, 1.0)
