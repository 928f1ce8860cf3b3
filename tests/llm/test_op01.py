import zlib

import numpy as np

from touchline.llm import op01_quality as op
from touchline.llm.common import F


def test_gradients_match_differences():
    w = {k: v.astype(np.float64) for k, v in op.initial_weights().items()}
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (0, 5, 300, 900)]
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 0.5])

    def loss():
        logit = op.forward(texts, w)[0]
        return float((weight * (np.logaddexp(0, logit) - y * logit)).mean())

    got = op.gradients(texts, y, weight, w)
    for name, v in w.items():
        for at in rng.integers(0, v.size, 6):
            old = v.flat[at]
            v.flat[at] = old + 1e-5
            up = loss()
            v.flat[at] = old - 1e-5
            down = loss()
            v.flat[at] = old
            assert abs((up - down) / 2e-5 - np.asarray(got[name]).flat[at]) < 1e-4


def test_long_texts_pool_over_passes(monkeypatch):
    w = op.initial_weights()
    text = bytes(np.random.default_rng(0).integers(32, 127, 9_000, dtype=np.uint8))
    whole = op.score_texts([text, b"x"], w)
    monkeypatch.setattr(op, "PASS_BYTES", 1024)
    assert np.allclose(op.score_texts([text, b"x"], w), whole, atol=1e-6)


def test_long_texts_teach_as_whole_ones(monkeypatch):
    w = op.initial_weights()
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (40, 5000, 700, 0, 2048)]
    y, weight = np.array([1.0, 0, 1, 0, 1], np.float32), np.array([1.0, 2, 1, 0.5, 1])
    whole = op.batch_gradients(texts, y, weight, w)
    monkeypatch.setattr(op, "PASS_BYTES", 512)
    parts = op.batch_gradients(texts, y, weight, w)
    for k in whole:
        assert np.allclose(whole[k], parts[k], atol=1e-5), k


def brute_logit(text, w):
    """The network byte by byte, as the docstring has it."""
    halves = max(1, -(-len(text) // op.HALF))
    padded = text.ljust((halves + 1) * op.HALF, b"\0")
    filters = w["conv"].reshape(op.WIDTH, op.EMBED, op.FILTERS)
    on = []
    for at in range(0, len(padded), op.STEP):
        window = padded[at : at + op.WIDTH]
        if len(window) < op.WIDTH:
            on.append(np.zeros(op.FILTERS))
            continue
        on.append(np.maximum(w["shift"] + sum(w["embed"][b] @ filters[k] for k, b in enumerate(window)), 0))
    per = op.CHUNK // op.STEP
    chunks = np.array([np.mean(on[i * per // 2 : i * per // 2 + per], axis=0) for i in range(halves)])
    return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ w["out"] + w["bias"][0]


def test_forward_agrees_with_brute_force():
    w = op.initial_weights(7)
    rng = np.random.default_rng(2)
    w["shift"], w["bias"] = rng.normal(0, 0.2, op.FILTERS).astype(np.float32), np.array([0.3], np.float32)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 7, 127, 128, 129, 256, 1000)]
    assert np.allclose(op.forward(texts, w)[0], [brute_logit(t, w) for t in texts], atol=1e-4)


def test_slices_learn_together(spark):
    rng = np.random.default_rng(1)
    rows = [(bytes(rng.choice(list(b"abcdef " if i % 2 else b"uvwxyz 123"), 600).astype(np.uint8)), i % 2, i) for i in range(120)]
    w = op.train(spark.createDataFrame(rows, "text binary, label int, order long"), slice_bytes=20_000)
    p = op.score_texts([t for t, _, _ in rows], w)
    assert np.mean((p >= 0.5) == [y == 1 for _, y, _ in rows]) > 0.95


def test_held_out_accuracy_on_labelled_documents(spark):
    root = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op.op1_quality(spark, root).collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    known = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{root}/labels.parquet").collect()]
    held = [(r.predicted == q) for r, q in known if r.held_out]
    assert len(held) > 50 and np.mean(held) > 0.95


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "fine words", None), (2, None, 0.5), (3, "", 0.5), (None, "x" * 100_000, 0.5), (1, "fine words", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (3, None)], "doc_id long, quality int")
    docs = docs.withColumn("score_", F.lit(1)).withColumn("__bytes", F.lit("x"))
    got = op.score(docs, op.fit(docs, labels))
    assert got.columns == [*docs.columns, "score__"] and got.count() == 5
    one_kind = op.fit(docs, labels.where("quality = 1"))
    assert {round(r.score__, 4) for r in op.score(docs, one_kind).collect()} == {round(2 / 3, 4)}
    assert op.score(docs.limit(0), one_kind).count() == 0
    kept = op.keep_good(docs, labels.where("quality = 1"))
    assert kept.columns == docs.columns and kept.count() == 5
