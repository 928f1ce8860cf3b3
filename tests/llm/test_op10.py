import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import op10_simhash as op
from touchline.llm.components import connected_components


def brute(texts, radius=3):
    prints = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        value = 0
        for bit in range(64):
            value |= (2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams)) << bit
        prints[i] = value
    root = {i: i for i in texts}
    for i in sorted(texts):
        todo, seen = [i], {i}
        while todo:
            x = todo.pop()
            for y in texts:
                if y not in seen and (prints[x] ^ prints[y]).bit_count() <= radius:
                    seen.add(y)
                    todo.append(y)
        root[i] = min(seen)
    return {i: (f"{prints[i]:016x}", root[i]) for i in texts}


def run(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, key int, n int")
    found = op.near_duplicates(df, **k).select("doc_id", op.hex_fingerprint(op.F.col("fp")), "component_id")
    return sorted(map(tuple, found.collect()), key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"W{i}" for i in range(300)]
    texts = {}
    for i in range(0, 90, 3):
        base = list(rng.choice(words, 200))
        texts[i] = " ".join(base)
        base[7] = "changed"
        texts[i + 1] = "\n".join(base)
        texts[i + 2] = texts[i] if i % 2 else " ".join(base[:2])
    texts |= {100: "", 101: None, 102: " \t", 103: "One two", 104: "one  TWO", 105: "a " * 30_000, 106: "É é ß"}
    got = run(spark, [(i, t, "x", 1, 2) for i, t in texts.items()])
    assert got == sorted([(i, *v) for i, v in brute(texts).items()], key=str)


def test_tiles_of_a_large_bucket_find_the_same(spark):
    rng = np.random.default_rng(1)
    base = list(rng.choice([f"w{i}" for i in range(50)], 400))
    rows = []
    for i in range(120):
        own = list(base)
        own[i * 3] = "other"
        rows.append((i, " ".join(own), None, 0, 0))
    assert run(spark, rows, bucket=16) == run(spark, rows) == sorted([(i, *v) for i, v in brute({r[0]: r[1] for r in rows}).items()], key=str)


def test_empty_repeated_and_null_ids(spark):
    assert run(spark, []) == []
    got = run(spark, [(1, "a b c", None, 0, 0)] * 3 + [(None, "a b c", None, 0, 0)])
    assert len(got) == 4 and {g[2] for g in got} == {1}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=5)), min_size=1, max_size=150), st.integers(0, 3))
def test_bit_sliced_forest_is_exact(rows, radius):
    base = rows[0][1]
    made = sorted((g, base ^ sum({1 << b for b in flips}) if v % 3 else v) for g, v, flips in rows)
    groups, values = np.array([g for g, _ in made]), np.array([v for _, v in made], np.uint64)
    root = op.forest(groups, values, radius)
    for i in range(len(made)):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for y in range(len(made)):
                if y not in seen and made[x][0] == made[y][0] and (made[x][1] ^ made[y][1]).bit_count() <= radius:
                    seen.add(y)
                    todo.append(y)
        assert root[i] == min(seen)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_radius_is_checked(spark):
    with pytest.raises(ValueError):
        op.fingerprint_links(spark.createDataFrame([(1,)], "fp long"), radius=4)
