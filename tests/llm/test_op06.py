import math
from collections import Counter

import pytest
from tests.llm.test_op04 import TEXTS

from touchline.llm import op06_token_counts as op


def lengths(texts):
    import base64

    import public_tokenizers
    import tiktoken

    with open(op.default_ranks(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode
    return [len(encode(t or "", disallowed_special=())) for t in texts]


def frame(spark, texts):
    return spark.createDataFrame([(i if i % 7 else None, t, 5, "s") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, n_docs string")


@pytest.mark.parametrize("span", [1, 3, 1024])
def test_report_agrees_with_brute_force(spark, span):
    texts = TEXTS + ["One word"] * 5 + ["a b c d e"] * 3 + [None, ""]
    n = lengths(texts)
    got = op.context_report(op.length_histogram(frame(spark, texts).repartition(3)), span).collect()
    assert {r.n_tokens: r.n_docs for r in got} == Counter(n) and len(got) == len(set(n))
    for r in got:
        at = r.n_tokens
        assert (r.docs_from, r.tokens_from) == (sum(x >= at for x in n), sum(x for x in n if x >= at))
        assert (r.docs_upto, r.truncated_total) == (sum(x <= at for x in n), sum(min(x, at) for x in n))
        assert (r.total_docs, r.total_tokens) == (len(n), sum(n))


def test_limits_and_quantiles(spark):
    n = sorted(lengths(TEXTS))
    report = op.context_report(op.length_histogram(frame(spark, TEXTS)))
    limits = [0, 1, 4, 4, 100, 10**9]
    assert {tuple(r) for r in op.totals_at(report, limits).collect()} == {(k, sum(min(x, k) for x in n), sum(x > k for x in n)) for k in limits}
    shares = [0.1, 0.5, 0.5, 0.9, 1.0]
    assert {tuple(r) for r in op.quantiles(report, shares).collect()} == {(s, n[math.ceil(s * len(n)) - 1]) for s in shares}


def test_empty_table(spark):
    report = op.context_report(op.length_histogram(frame(spark, TEXTS).where("false")))
    assert report.count() == 0 and op.totals_at(report, [5]).count() == 0 and op.quantiles(report, [0.5]).count() == 0


def test_query_covers_the_whole_table(spark, tmp_path):
    frame(spark, TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    (total,) = {(r.total_docs, r.total_tokens) for r in op.op6_token_counts(spark, str(tmp_path)).collect()}
    assert total == (len(TEXTS), sum(lengths(TEXTS)))
