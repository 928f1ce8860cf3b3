import hashlib
import random

import numpy as np
import pytest

from touchline.llm import op02_substrings as op


def brute(rows, span):
    seen = {}
    for n, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - span + 1):
            seen.setdefault(b[p : p + span], []).append((n, p))
    gone = [bytearray(len((t or "").encode())) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for n, p in places:
                gone[n][p : p + span] = b"\1" * span
    out = []
    for (i, t), g in zip(rows, gone, strict=True):
        b = (t or "").encode()
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        out.append((i, len(b), len(b) - len(kept), sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghé", k=rng.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.randint(5, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            t = rng.choice(rows)[1] or ""
            at = rng.randint(0, len(t))
            t = t[:at] + rng.choice(["", "x", word()]) + t[at + rng.randint(0, 3) :]
        elif kind < 0.3 and rows:
            t = rng.choice(rows)[1]
        elif kind < 0.8:
            t = prose(rng.randint(1, 30)) + "".join(rng.choice(passages) + prose(rng.randint(0, 6)) for _ in range(rng.randint(0, 4)))
        else:
            t = rng.choice(["ab" * rng.randint(1, 200), "z" * rng.randint(1, 500), (prose(3) + "\n") * 20])
        rows.append((i, t))
    return rows + [(n, None), (n + 1, ""), (n + 2, "q")]


def result(spark, rows, **k):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, k1 int, body string")
    found = op.remove_repeats(df, **k).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found)


@pytest.mark.parametrize("seed,span,gram,cell,group", [(1, 60, 16, 8, 1000), (2, 60, 16, 8, 3), (3, 33, 8, 4, 1000), (4, 100, 24, 16, 2)])
def test_agrees_with_brute_force(spark, seed, span, gram, cell, group):
    rows = texts(seed)
    assert result(spark, rows, span=span, gram=gram, cell=cell, group=group) == sorted(brute(rows, span))


def test_production_parameters(spark):
    rng = random.Random(8)
    prose = lambda k: "".join(rng.choices("abcde fghij", k=k))
    shared, edge = prose(700), prose(400)
    rows = [(i, prose(rng.randint(0, 900)) + shared[rng.randint(0, 200) : rng.randint(500, 700)] + prose(300)) for i in range(30)]
    rows += [(40, edge), (41, "x" + edge), (42, edge[:399] + "!"), (43, "y" * 3000), (44, rows[0][1]), (45, prose(399)), (46, rows[0][1] + rows[1][1])]
    rows += [rows[3], (47, prose(5))]
    assert result(spark, rows) == sorted(brute(rows, op.SPAN))


def test_passes_cut_long_texts():
    rng = random.Random(4)
    text = bytes(rng.choices(b"abcdefgh ", k=5000))
    whole = [0] * (len(text) - 59)
    for i, a, b, at, _, _, copies in op.stretches([text, b"short"], 60, 16, most=512):
        assert i == 0 and copies == 1 and a <= b and b <= at <= a + 44
        for p in range(a, b + 1):
            whole[p] += 1
    assert set(whole) == {1}


def test_matching_statistics():
    rng = np.random.default_rng(6)
    text = np.concatenate([np.append(rng.integers(0, 3, rng.integers(1, 30)), -1 - i) for i in range(40)])
    got = op.RunLengthIndex(text).matching_statistics()
    for i in range(len(text)):
        best = 0
        for j in range(len(text)):
            if i != j:
                k = 0
                while i + k < len(text) and j + k < len(text) and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
        assert got[i] == best


def test_empty_table(spark):
    assert result(spark, []) == []
