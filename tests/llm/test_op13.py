import random
from collections import defaultdict

import duckdb
import numpy as np

from touchline.llm import op13_minhash as op


def brute(rows, percent=85):
    def grams(text):
        words = (text or "").encode().lower().split()
        return {b" ".join(words)} if 0 < len(words) < 3 else {b" ".join(words[i : i + 3]) for i in range(len(words) - 2)}

    sets = [(i, grams(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    low = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        if i is not None:
            low[find(x)].append(i)
    out = []
    for x, (i, s) in enumerate(sets):
        first = min(low[find(x)], default=None)
        out.append((i, len(s), first, i == first))
    return sorted(out, key=str)


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, c string, n int")
    return sorted(map(tuple, op.near_duplicates(df, **k).collect()), key=str)


def edited(rng, words, share):
    return [rng.choice(VOCAB) if rng.random() < share else w for w in words]


VOCAB = [f"word{i}" for i in range(400)]


def test_matches_brute_force_near_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for group in range(12):
        base = [rng.choice(VOCAB) for _ in range(rng.choice([12, 60, 150, 700]))]
        rows += [(None, " ".join(edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.05, 0.08])))) for _ in range(12)]
        chain = base
        for _ in range(6):  # each step links with the one before only
            chain = [*chain[len(chain) // 14 :], *(rng.choice(VOCAB) for _ in range(len(chain) // 14))]
            rows.append((None, " ".join(chain)))
    rows = [(i, t) for i, (_, t) in enumerate(rng.sample(rows, len(rows)))]
    want = brute(rows)
    assert len({w[2] for w in want}) < len(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, bucket=3) == want


def test_edge_cases(spark):
    words = " ".join(VOCAB[:100])
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE two"), (8, words), (8, words), (8, words + " more"), (None, words), (None, words + " other"), (None, "lonely one here"), (9, words.upper()), (10, None)]
    rows += [(11, "long " * 300_000 + words), (12, "long " * 200_000 + words)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "a b c"), (3, "d e f")]) == brute([(1, None), (2, "a b c"), (3, "d e f")])


def test_pairs_within_the_threshold_share_a_key(spark):
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, op.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        b[rng.choice(op.SYMBOLS, op.THRESHOLD, replace=False)] ^= 1
        chunks = (a != b).reshape(op.CHUNKS, op.WIDTH).sum(axis=1)
        assert chunks.min() <= op.ERRORS
    keys = op.bucket_keys(spark.createDataFrame([(b"x", bytes(a.tobytes())), (b"y", bytes(b.tobytes()))], "c binary, sig binary")).collect()
    held = [{r.key for r in keys if r.c == c} for c in (b"x", b"y")]
    assert len(held[0]) == op.CHUNKS * len(op.KEPT) and held[0] & held[1]


def test_bounds_rule_out_no_link():
    rng = np.random.default_rng(4)
    for size in (8, 50, 400, 3000):
        for _ in range(50):
            shared = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            a, b = (np.unique(np.append(shared, rng.integers(0, 1 << 63, rng.integers(0, size // 8 + 1), dtype=np.uint64))) for _ in range(2))
            both = len(np.intersect1d(a, b))
            bits = int(np.unpackbits(op.parity_sketch(a) ^ op.parity_sketch(b)).sum())
            assert bits <= len(a) + len(b) - 2 * both
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert bits <= op.differing_bits(85, np.array(len(a) + len(b)))


def test_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(op.ORACLES["op13_minhash"]).fetchall()
    got = op.op13_minhash(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)
