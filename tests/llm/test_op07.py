import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from touchline.llm import op07_toxicity as op


def sample(n=240, seed=5):
    rng = random.Random(seed)
    common = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}w{i}" for i in range(90)]
    vile = [f"v{chr(97 + i)}le{i}" for i in range(12)]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(common, k=rng.randint(5, 40)) + (rng.choices(rng.sample(vile, 2), k=8) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def counted(texts):
    return Counter(t for x in texts for t in op.terms(x))


def brute_vector(text, df, n, known):
    own = Counter()
    for word in re.findall(r"\w+", text.lower()):
        for term, share in ((word[:4] + "-", 1.0), (word, op.WORD_WEIGHT)):
            if (share == 1 or len(word) > 4) and term in known:
                own[term] += share * max(0.0, math.log((n - df[term] + 0.5) / (df[term] + 0.5)) - math.log(4))
    norm = math.sqrt(sum(x * x for x in own.values())) or 1.0
    return {t: x / norm for t, x in own.items()}


@pytest.mark.parametrize("word_weight", [0.0, 0.2])
def test_nearest_is_exact(monkeypatch, word_weight):
    monkeypatch.setattr(op, "WORD_WEIGHT", word_weight)
    rows = sample()
    texts = [t for _, t, _ in rows] + ["aaw0 aaw0 aaw0", "Inflected inflection"]
    df, n = counted(texts), len(texts)
    known = set(counted([t for _, t, _ in rows]))
    own = op.build([op.terms(t) for _, t, _ in rows], np.array([y for _, _, y in rows], float), [i for i, _, _ in rows], df, n)
    vectors = [brute_vector(t, df, n, known) for _, t, _ in rows]
    for text in [t for _, t, _ in rows[:80]] + ["vble1 vble1 vcle2 nothing", "", texts[3] * 4]:
        query = brute_vector(text, df, n, known)
        every = [(round(sum(w * v.get(t, 0) for t, w in query.items()), 12), i) for i, v in enumerate(vectors)]
        want = sorted((x for x in every if x[0] > 0), key=lambda x: (-x[0], x[1]))[: op.NEIGHBOURS]
        got = op.nearest(own, op.vector(op.terms(text), own.vocabulary, own.idf))
        assert np.allclose([c for c, _ in got], [c for c, _ in want], atol=1e-9)
        last = want[-1][0] if want else 0
        assert {i for c, i in got if c > last + 1e-9} == {i for c, i in want if c > last + 1e-9}


def test_counts_of_terms_matter():
    texts = ["aaaa bbbb", "aaaa aaaa aaaa bbbb", "cccc", "dddd"]
    own = op.build([op.terms(t) for t in texts], np.array([1.0, 0, 0, 0]), [1, 2, 3, 4], counted(texts), 40)
    assert [i for _, i in op.nearest(own, op.vector(op.terms("aaaa aaaa aaaa aaaa bbbb"), own.vocabulary, own.idf))] == [1, 0]


def test_document_counts_cover_all_rows(spark):
    rows = sample(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(99, None), (98, "")], "doc_id long, text string").repartition(5)
    want = Counter(t for _, x, _ in rows for t in set(op.terms(x)))
    vocabulary = sorted(want)[::2] + ["none"]
    having, n = op.document_counts(docs, vocabulary)
    assert (having.tolist(), n) == ([want.get(t, 0) for t in vocabulary], 62)


def test_scores_whole_texts_and_edge_cases(spark):
    rows = sample()
    filler = " ".join(["aaw0 baw1 caw2"] * 30_000)
    more = [(1000, None), (1001, ""), (1002, filler + " vale0 vble1 vcle2" * 30_000), (1003, filler), (1004, "vdle3 vele4"), (1004, "vdle3 vele4"), (None, "aaw0")]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(i, t, 2) for i, t in more], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 1), (5000, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    got = {}
    for r in op.score(docs, op.fit(docs, labels)).collect():
        assert 0 <= r.score <= 1
        got.setdefault(r.doc_id, []).append(r.score)
    right = sum((got[i][0] >= 0.5) == bool(y) for i, _, y in rows)
    assert right >= 0.97 * len(rows)
    assert got[1002][0] >= 0.5 and got[1004] == [got[1004][0]] * 2 and got[1004][0] >= 0.5
    assert max(got[1003] + got[None]) < 0.5


def test_one_kind_of_label_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in op.score(docs, op.fit(docs, none)).collect()} == {0.5}
    only = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    scores = {r.score for r in op.score(docs, op.fit(docs, only)).collect()}
    assert len(scores) == 1 and 0.5 <= scores.pop() < 1
    empty = docs.limit(0)
    assert op.score(empty, op.fit(empty, only)).count() == 0


def test_logistic_weighs_both_labels_alike():
    x = np.array([0.0] * 100 + [1.0] * 100)
    y = np.array([0] * 80 + [1] * 20 + [0] * 20 + [1] * 80, float)
    a, b = op.logistic(x, y)
    assert math.isclose(1 / (1 + math.exp(-b)), 0.2, abs_tol=0.02) and math.isclose(1 / (1 + math.exp(-a - b)), 0.8, abs_tol=0.02)
    few = np.concatenate([np.zeros(900), np.ones(100)])
    labels = np.concatenate([np.zeros(900), np.ones(90), np.zeros(10)])
    a, b = op.logistic(few, labels)
    assert 1 / (1 + math.exp(-a - b)) > 0.9 > 0.5 > 1 / (1 + math.exp(-b))


def test_numbered_terms_equal_counted_ones():
    text = "Inflected inflection inflect 7 of the théâtre, Théâtres of-it " * 3
    found = op.terms(text)
    vocabulary = {t: i for i, t in enumerate(sorted(found)[::2])}
    at, n = op.numbered(text, op.Numbering(vocabulary))
    assert list(zip(at.tolist(), n.tolist(), strict=True)) == sorted((vocabulary[t], k) for t, k in found.items() if t in vocabulary)
    assert [len(x) for x in op.numbered("", op.Numbering(vocabulary))] == [0, 0]
