import hashlib
import time
from collections import defaultdict

from touchline.llm import op05_line_dedup as op
from touchline.llm.common import F

BLANKS = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(UPPER)
    low = lambda i: -(10**9) if i is None else i
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(low(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == low(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in rows], "doc_id long, text string, at int, h1 string, salt int")
    found = op.dedup_lines(df, **k)
    assert set(df.columns) < set(found.columns)
    return sorted(map(tuple, found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()), key=str)


SHARED = "  A line that Many documents Share \t"


def test_matches_brute_force(spark):
    rows = [(i, "\n".join([f"own line number {i} of this text", SHARED if i % 3 else SHARED.strip().upper(), "short", "Était une ligne À part, une seule" if i < 5 else "", SHARED if i % 7 == 0 else "z"])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, SHARED * 2_000), (104, "\n".join([SHARED] * 5000)), (105, "x" * 19 + "\n" + "y" * 20), (106, "y" * 20), (107, "y" * 20), (108, "x" * 19), (109, "x" * 19)]
    rows += [(200 + i, "only two documents hold this line\r") for i in range(2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, salts=1) == brute(rows)
    assert run(spark, rows, salts=3) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, SHARED + "\nx"), (1, SHARED + "\nx"), (2, SHARED), (2, SHARED + "\n" + SHARED)]
    assert run(spark, rows) == brute(rows)
    rows += [(None, SHARED + "\n" + SHARED)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_bitmap_is_runs(spark):
    rows = [(i, "\n".join([SHARED, "a", SHARED, SHARED, "b"])) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    maps = {r.doc_id: (r.n_dropped, r.keep_runs) for r in op.keep_bitmaps(df).collect()}
    assert maps == {0: (3, [0, 1, 1, 2]), 1: (3, [0, 1, 1, 2])}


def test_thousands_of_runs_take_linear_time(spark):
    rows = [(d, "\n".join(f"shared line of all documents {i}" if i % 2 else f"own line {i} of the document {d}" for i in range(20_000))) for d in range(3)]
    began = time.perf_counter()
    assert run(spark, rows) == brute(rows)
    assert time.perf_counter() - began < 60
