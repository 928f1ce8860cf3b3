import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from touchline.llm import op03_maxent as op

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def sample(n=150, seed=2):
    rng = random.Random(seed)
    tongues = [[f"{p}{i}" for i in range(40)] for p in ("th", "de", "un", "ka")]
    rows = []
    for i in range(n):
        words = rng.choice(tongues)
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(1, 60)) + ["The", "x" + str(i)])))
    return rows + [(n, None), (n + 1, ""), (n + 2, "  \t\n "), (n + 3, "ÄB äb\xa0c"), (5, rows[5][1]), (None, "the end")]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*SPLIT.findall(low), None]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, block int, score int")


@pytest.mark.parametrize("block_bytes", [1 << 30, 700])
def test_base_scores_agree_with_brute_force(spark, block_bytes):
    rows = sample()
    c = Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), is_held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    got = op.scores(frame(spark, rows).repartition(5), block_bytes=block_bytes).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_blocks_do_not_change_the_model(spark):
    rows = frame(spark, sample(60))
    a, b = ({(r.doc_id, r.n_tokens): round(r.score, 5) for r in op.scores(rows, block_bytes=x).collect()} for x in (1 << 30, 500))
    assert a == b


def test_beats_the_base_on_held_out_texts_and_training_helps(spark):
    rows = frame(spark, sample(400))
    held = {}
    for rounds in (0, op.ROUNDS):
        got = [r for r in op.scores(rows, rounds=rounds).collect() if r.held_out]
        held[rounds] = sum(r.score for r in got)
        base = sum(r.base_score for r in got)
    assert held[op.ROUNDS] > held[0] > base


def brute_scores(rows, rounds):
    """The whole model token by token in plain Python floats."""
    k_classes, parts, heads_n = op.CLASSES, op.PARTS, op.HEADS
    texts = [(i, [op.END if w is None else w.encode() for w in tokens(t)]) for i, t in rows]
    train = [(i, t) for i, t in texts if not is_held(i)]
    count = Counter(w for _, t in train for w in t)
    top = sorted((w for w in count if w != op.END), key=lambda w: (-count[w], op.word_hash(w)))[:heads_n]
    hashed, mask = op.hashed_rows(sum(count.values())), (1 << 64) - 1

    def class_of(w):
        return 1 + top.index(w) if w in top else op.letter_class(w)

    def leaf(w):
        c = class_of(w)
        return c, ((op.word_hash(w) & mask) >> 7) % parts if c > heads_n else 0

    def rows_of(t, at):
        back = [t[at - k] if at >= k else op.END for k in range(5)]
        c = [class_of(w) for w in back]
        h = [op.word_hash(w) & mask for w in back]
        both = ((h[1] * 0x9E3779B97F4A7C15 + h[2] * 0xD1342543DE82EF95) & mask) >> 24
        mine = c[0] * 0xD1342543DE82EF95 & mask
        near, far = (((x ^ mine) * 0x9E3779B97F4A7C15 & mask) >> 24 for x in (h[1], h[2]))
        return [("a", c[1], c[2]), ("b", c[2], c[3]), ("c", c[3], c[4]), ("d", (h[1] >> 20) % hashed), ("e", both % hashed)], [("f", c[0], c[1]), ("g", near % hashed), ("h", far % hashed)]

    def softmax(base, table, keys):
        x = [b + sum(table[k][j] if k in table else 0.0 for k in keys) for j, b in enumerate(base)]
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    def gather(docs, model=None):
        seen, hoped = {}, {}
        for _, t in docs:
            for at, w in enumerate(t):
                c, s = leaf(w)
                first, second = rows_of(t, at)
                for keys, got, size, base in ((first, c, k_classes, "all"), (second, s, parts, ("class", c))):
                    if base != "all" and c <= heads_n:
                        continue
                    p = softmax(model[base], model, keys) if model else None
                    for k in [*keys, base]:
                        seen.setdefault(k, [0.0] * size)[got] += 1
                        if p:
                            hoped[k] = [a + b for a, b in zip(hoped.get(k, [0.0] * size), p, strict=True)]
        return seen, hoped

    seen, _ = gather(train)
    share = lambda n: [(x + 0.5) / (sum(n) + 0.5 * len(n)) for x in n]
    odds = lambda n, s, f: [math.log((x + op.PRIOR * y) / (sum(n) + op.PRIOR) / y) / f for x, y in zip(n, s, strict=True)]
    none = [0.0] * parts
    whole = {c: share(seen.get(("class", c), none)) for c in range(k_classes)}
    sums = [sum(seen.get(("class", c), none)[j] for c in range(k_classes)) for j in range(parts)]
    every = [(x + 0.5) / (sum(sums) + 0.5 * k_classes * parts) for x in sums]
    model = {"all": [math.log(x) for x in share(seen["all"])]} | {("class", c): [math.log(x) for x in whole[c]] for c in range(k_classes)}
    for k, n in seen.items():
        if k[0] in "abcde" and k != "all":
            model[k] = odds(n, share(seen["all"]), op.FEATURES)
        elif k[0] == "f":
            model[k] = odds(n, whole[k[1]], op.PART_FEATURES)
        elif k[0] in "gh":
            model[k] = odds(n, every, op.PART_FEATURES)
    leaves = {}
    for w, n in count.items():
        leaves.setdefault(leaf(w), []).append(n)
    for c in range(k_classes):
        for x in range(parts):
            if (c, x) not in leaves:
                model["class", c][x] = op.EMPTY
    for docs in rounds:
        seen, hoped = gather([x for x in train if x[0] in docs], model)
        for k in seen:
            model[k] = [m + op.STEP * (a - b) / (b + op.PRIOR) for m, a, b in zip(model.get(k, [0.0] * len(seen[k])), seen[k], hoped[k], strict=True)]
    out = []
    for i, t in texts:
        total = 0.0
        for at, w in enumerate(t):
            c, s = leaf(w)
            first, second = rows_of(t, at)
            own, same = leaves.get((c, s), []), [n for (k, _), v in leaves.items() if k == c for n in v]
            unknown = op.DISCOUNT * len(same) / sum(same) if same else 1.0
            total += math.log10(softmax(model["all"], model, first)[c])
            if not count[w]:
                total += math.log10(unknown)
                continue
            if c > heads_n:
                total += math.log10(softmax(model["class", c], model, second)[s])
            total += math.log10((1 - unknown) * (count[w] - op.DISCOUNT) / (sum(own) - op.DISCOUNT * len(own)))
        out.append((str(i), round(total, 2)))
    return sorted(out)


@pytest.mark.parametrize("rounds", [0, 2])
def test_scores_agree_with_brute_force(spark, rounds):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in sample(40) if i is not None]
    df = frame(spark, rows)
    shares = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(op.SHARES))).collect()}
    want = brute_scores(rows, [{i for i, s in shares.items() if s == k} for k in range(rounds)])
    got = sorted((str(r.doc_id), r.score) for r in op.scores(df, rounds=rounds).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=0.02)


def small_model(rng):
    leaves = op.CLASSES * op.PARTS
    table, parts = (rng.normal(0, 1, (n, op.CLASSES)).astype(np.float32) for n in (op.ROWS, op.part_rows(op.HASHED)))
    return op.Model({}, np.zeros(op.CLASSES, np.float32), table, parts, np.full(leaves, 30.0), np.full(leaves, 4.0), 30 * leaves, 4 * leaves)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    model = small_model(rng)
    p = model.class_probabilities(rng.integers(0, op.ROWS, (op.FEATURES, 50)))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    q = model.part_probabilities(rng.integers(0, op.part_rows(op.HASHED), (op.PART_FEATURES, 50)), rng.integers(0, op.CLASSES, 50))
    assert np.allclose(q.sum(axis=1), 1, atol=1e-5)
    # A class whose every leaf has four words, and its unknown word.
    leaves, counts = np.repeat(np.arange(op.PARTS), 4), np.tile([10, 10, 5, 5], op.PARTS)
    known = model.within(leaves, counts).reshape(op.PARTS, 4).sum(axis=1)
    assert math.isclose(known.mean() + model.within(np.zeros(1, int), np.zeros(1, int))[0], 1)


def test_tokens_are_those_of_bytes_split_at_ascii_space():
    odd = [None, b"", b" ", b"\n\t x\x0b\x0cY \r", b"\xff\xfe A\xc3\x84 \x85b\xa0c", b"a", b"\x1c\x1d a\x00b", b"A a A"]
    whole = pa.array([b"before", *odd], pa.binary())
    for texts in (odd, odd[:1], odd[1:3], [], whole.slice(1), pa.chunked_array([whole.slice(1, 3), whole.slice(4)])):
        words = op.Words()
        tokens, starts = op.tokens_of(texts, words)
        known, texts = list(words), texts if isinstance(texts, list) else texts.to_pylist()
        want = [[*(t or b"").lower().split(), op.END] for t in texts]
        assert [known[i] for i in tokens] == [w for ws in want for w in ws]
        assert starts.tolist() == [sum(map(len, want[:i])) for i in range(len(want))]
        assert sorted(known) == sorted({op.END, *(w for ws in want for w in ws)}) and known[words[op.END]] == op.END


def test_feature_rows_stay_within_texts():
    words = op.Words()
    tokens, starts = op.tokens_of([b"a b c", b"d e", None, b"a b c"], words)
    own = op.traits(words, {})
    for rows, most in zip(op.feature_rows(tokens, starts, own, words[op.END]), (op.ROWS, op.part_rows(op.HASHED)), strict=True):
        assert (rows[:, :4] == rows[:, -4:]).all() and rows.min() >= 0 and rows.max() < most


def test_empty_table_and_no_training_rows(spark):
    assert op.scores(frame(spark, [])).count() == 0
    held = [(i, "some words") for i in range(40) if is_held(i)]
    got = op.scores(frame(spark, held)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}


def test_rounds_learn_from_every_training_document(spark, monkeypatch):
    rows, seen, counts = sample(), [], op.feature_counts

    def spied(docs, heads, model=None, *args, **kwargs):
        if model is not None:
            seen.extend(r.doc_id for r in docs.select("doc_id").collect())
        return counts(docs, heads, model, *args, **kwargs)

    monkeypatch.setattr(op, "feature_counts", spied)
    op.scores(frame(spark, rows)).collect()
    assert Counter(seen) == Counter(i for i, _ in rows if not is_held(i))


def test_hashed_rows_grow_with_the_corpus():
    assert op.hashed_rows(0) == op.hashed_rows(10**6) == op.HASHED < op.hashed_rows(10**8) < op.hashed_rows(10**10)
    words = op.Words()
    tokens, starts = op.tokens_of([" ".join(f"w{i}" for i in range(9000)).encode()], words)
    own = op.traits(words, {})
    few, many = (op.feature_rows(tokens, starts, own, words[op.END], h)[0] for h in (op.HASHED, 8 * op.HASHED))
    for feature in (3, 4):
        assert len(set(many[feature])) > 3 * len(set(few[feature]))
    assert many.max() < op.table_rows(8 * op.HASHED)
