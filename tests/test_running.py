import random
import statistics

from pyspark.sql import functions as F

from touchline.operators.running import running, span_bounds, span_of


def busy(n=6000):
    """Nine rows in ten lie in one week, and half of these at one time."""
    rng = random.Random(9)
    out = []
    for i in range(n):
        at = rng.randint(0, 10**8) if i % 10 == 0 else 5 * 10**7 + (3600 if i % 2 else rng.randint(0, 604_800))
        out.append((i, at, rng.randint(0, 9)))
    return out


def test_totals_of_a_busy_week(spark):
    rows = busy()
    df = spark.createDataFrame(rows, "id long, at long, x long").repartition(5)
    want, total, most = {}, 0, -1
    for i, at, x in sorted(rows, key=lambda r: (r[1], r[0])):
        total, most = total + x, max(most, x * at % 101)
        want[i] = (total, most)
    totals = {"total": ("sum", F.col("x")), "most": ("max", F.col("x") * F.col("at") % 101)}
    for span_rows in (200, 10_000, 10**9):
        got = {r.id: (r.total, r.most) for r in running(df, "at", ["at", "id"], totals, span_rows).collect()}
        assert got == want


def test_spans_follow_the_rows(spark):
    df = spark.createDataFrame(busy(20_000), "id long, at long, x long")
    bounds = span_bounds(df, ["at", "id"], 40)
    counts = [r["count"] for r in df.groupBy(span_of(df, ["at", "id"], bounds).alias("s")).count().collect()]
    assert len(counts) >= 38 and max(counts) <= 2 * statistics.median(counts)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, 5, 2)], "id long, at long, x long")
    assert running(df, "at", ["at", "id"], {"t": ("sum", F.col("x"))}, 1).first().t == 2
    assert running(df.where("x < 0"), "at", ["at", "id"], {"t": ("sum", F.col("x"))}).collect() == []
