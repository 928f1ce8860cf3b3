import hashlib
import random

import pytest

from touchline.llm import op08_fingerprints as op


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, k1 string, first int")


def texts(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    return [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(n)]


def edited_texts(rows):
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        q = len(t) // 4
        out[i] = t[: len(t) - q] + after[:q]
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_edited_texts(spark, parts):
    rows = [(5 * i, t) for i, t in enumerate(texts(60))] + [(2, None), (3, ""), (4, " \n "), (7, "short"), (None, "no id at all")]
    rows += [rows[9], rows[9]]
    got = op.edited_fingerprints(frame(spark, rows).repartition(parts)).collect()
    want = edited_texts(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.edited == want[r.doc_id]
    order = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i or 0))
    assert {r.doc_id: r.next_id for r in got} == dict(zip(order, order[1:] + order[:1], strict=True))


def test_anchors_are_closed_syncmers(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, enumerate(texts(8)))
    units = {r.doc_id: (r.u, r.s) for r in docs.select("doc_id", op.unit_hashes(F.col("text")).alias("u"), op.inner_hashes(op.unit_hashes(F.col("text"))).alias("s")).collect()}
    found = {}
    for r in op.anchors(docs).collect():
        found.setdefault(r.doc_id, []).append(r.at)
    for i, (u, s) in units.items():
        assert len(s) == max(0, len(u) - 1)
        if len(u) >= op.K:
            inner = op.K - op.S + 1
            want = [k for k in range(len(u) - op.K + 1) if min(s[k : k + inner]) in (s[k], s[k + inner - 1])]
        else:
            want = list(range(len(u)))
        assert sorted(found.get(i, [])) == want


def test_anchors_need_no_context(spark):
    passage = texts(1, seed=9)[0] + " and a few more words to make the passage long enough"
    docs = frame(spark, [(1, passage), (2, "before it. " + passage + " behind it")])
    by = {1: set(), 2: set()}
    for r in op.anchors(docs).collect():
        by[r.doc_id].add(r.hash)
    assert by[1] <= by[2]


def brute_fingerprint(anchors, size=op.SIZE, share=op.SHARE):
    first = {}
    for at, h in sorted(anchors):
        first.setdefault(h & op.TOP, at)
    kept = sorted(first.items())
    return [(h, at) for i, (h, at) in enumerate(kept) if i < size or h < op.TOP // share]


def brute_likeness(a, b, size=op.SIZE, share=op.SHARE):
    if not a and not b:
        return 1.0
    reach = min(op.TOP if len(x) < size else max(x[size - 1][0], op.TOP // share - 1) for x in (a, b))
    a, b = ({h: at for h, at in x if h <= reach} for x in (a, b))
    met = sorted((a[h], b[h] - a[h]) for h in a.keys() & b.keys())
    line = [None, *(d for _, d in met), None]
    good = 1 if len(met) == 1 else sum(line[i] in (line[i - 1], line[i + 1]) for i in range(1, len(line) - 1))
    return good / max(min(len(a), len(b)), 1)


def test_fingerprints_and_likeness_agree_with_brute_force(spark):
    from pyspark.sql import functions as F

    long = texts(40)
    whole = " ".join(long)
    cases = [("a b c d e f g h", "a b c d e f g h"), ("", ""), ("", "some words"), ("one two three", "four five six"), ("one", "one"), (whole, whole), (whole, " ".join(long[:30])), (" ".join(long[:10]), " ".join(long[10:])), (" ".join(long[:10]), " ".join(long[::-1])), (long[0] * 6, long[0] + long[1]), (long[3], "x " + long[3])]
    cases += [(" ".join(long[i : i + 8]), " ".join(long[i + 1 : i + 3] + long[i + 5 : i + 9])) for i in range(0, 30, 3)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string")
    for size, share in ((op.SIZE, op.SHARE), (6, 3)):
        prints = df.select("i", op.anchor_hashes(F.col("a")).alias("a"), op.anchor_hashes(F.col("b")).alias("b"), op.fingerprint(F.col("a"), size, share).alias("p"), op.fingerprint(F.col("b"), size, share).alias("q"))
        got = {r.i: r for r in prints.withColumn("likeness", op.likeness(F.col("p"), F.col("q"), size, share)).withColumn("text", op.as_text(F.col("p"))).collect()}
        for i in range(len(cases)):
            a, b = (brute_fingerprint([(x.at, x.hash) for x in side], size, share) for side in (got[i].a, got[i].b))
            assert [(x >> 32, x & 0xFFFFFFFF) for x in got[i].p] == a and [(x >> 32, x & 0xFFFFFFFF) for x in got[i].q] == b
            assert got[i].text == "".join(f"{h:08x}{at:08x}" for h, at in a)
            assert abs(got[i].likeness - brute_likeness(a, b, size, share)) < 1e-12
        assert [got[i].likeness for i in (0, 1, 2, 3, 4, 5)] == [1, 1, 0, 0, 1, 1] and got[6].likeness > 0.8 and got[7].likeness < 0.1


def test_matches_off_any_diagonal_do_not_count(spark):
    from pyspark.sql import functions as F

    parts = [" ".join(f"w{i}x{j}" for j in range(6)) for i in range(60)]
    shuffled = parts[:]
    random.Random(4).shuffle(shuffled)
    one = spark.createDataFrame([(" ".join(parts), " ".join(shuffled))], "a string, b string")
    prints = one.select(op.fingerprint(F.col("a")).alias("a"), op.fingerprint(F.col("b")).alias("b"))
    row = prints.select(op.likeness(F.col("a"), F.col("b")).alias("likeness"), F.size(F.array_intersect(F.transform("a", lambda x: F.shiftright(x, 32)), F.transform("b", lambda x: F.shiftright(x, 32)))).alias("shared"), F.size("a").alias("n")).first()
    assert row.likeness < row.shared / row.n


def test_query_and_equal_texts(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(30))]
    rows += [(100, rows[3][1]), (101, rows[3][1])]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op.op8_fingerprints(spark, str(tmp_path)).collect()}
    want = edited_texts(rows)
    assert got[3].fingerprint == got[100].fingerprint and got[100].near_next == 1
    for i, t in rows:
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1
        own, edited = ([(int(p[k : k + 8], 16), int(p[k + 8 : k + 16], 16)) for k in range(0, len(p), 16)] for p in (got[i].fingerprint, got[i].edited_fingerprint))
        assert abs(got[i].near_edited - brute_likeness(own, edited)) < 1e-12


def test_empty_and_single(spark):
    assert op.edited_fingerprints(frame(spark, [])).count() == 0
    one = op.edited_fingerprints(frame(spark, [(1, "abcdefgh")])).first()
    assert one.edited == "abcdef" + "ab"
