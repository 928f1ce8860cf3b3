import struct
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import op04_packing as op

TEXTS = [None, "", " \n", "One word", "it's 2024, don't.. stop.,\tCafé ¶ a¶b ¶", "x" * 9000, "Wörter. " * 3000, "é. <|endoftext|> a b\x1cc 　 d", "\U0001f600,,, ...", "Σας. ΟΔΟΣ, I'LL.", "<|startoftext|>A<|endoftext|>b. <|ENDOFTEXT|> x<|endoftext|>, <|endoftext|>. <|endoftext|><|endoftext|>"]


def plain(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op.default_tokenizer())
    return tok.encode(text or "", add_special_tokens=False).ids + [2]


def test_round_trip(spark):
    rows = [(i, t, 5, "s") for i, t in enumerate(TEXTS)] + [(None, "null id", 1, ""), (3, "One word", 5, "s")]
    pieces = op.pack(spark.createDataFrame(rows, "doc_id long, text string, start int, ids string")).collect()
    held = defaultdict(list)
    for p in pieces:
        ids = list(struct.unpack(f"<{p.length}I", p.ids))
        assert p.length <= op.MAX_LEN and p.length & (p.length - 1) == 0 and p.offset == 0
        held[p.doc_id].append((p.start, ids, p.doc_tokens))
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for i, t in [*enumerate(TEXTS), (None, "null id")]:
        if i == 3:
            assert len(held[3]) == 2 * len(op.piece_lengths(len(plain(t)), op.MAX_LEN))
            continue
        got = [x for _, ids, _ in sorted(held[i]) for x in ids]
        assert got == plain(t) and {n for *_, n in held[i]} == {len(got)}
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in op.packed_digest(op.pack(spark.createDataFrame(rows[:6], "doc_id long, text string, start int, ids string"))).collect()}
    assert digest[5, 0] == zlib.crc32(struct.pack("<4096I", *plain(TEXTS[5])[:4096])) if len(plain(TEXTS[5])) >= 4096 else digest[5, 0]


def test_empty_table_and_buckets(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.pack(empty).count() == 0
    op.write_buckets(op.pack(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert sorted(r.bucket for r in back.collect()) == [4]


def test_rejects_odd_windows(spark):
    with pytest.raises(ValueError):
        op.pack(spark.createDataFrame([], "doc_id long, text string"), max_len=100)


@given(st.integers(1, 100_000), st.integers(0, 12))
def test_piece_lengths(n, bits):
    got = op.piece_lengths(n, 1 << bits)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= 1 << bits for x in got) and len(got) <= n >> bits | 0 or len(got) <= (n >> bits) + bits


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abZ.,'s !?0é¶́\n\t<|>"), max_size=60))
def test_words_match_whole_text(text):
    memo = op._word_ids(op.default_tokenizer())
    words = text.encode().split()
    memo.learn(set(words))
    assert list(struct.unpack(f"<{len(b''.join(map(memo.__getitem__, words))) // 4}I", b"".join(map(memo.__getitem__, words)))) == plain(text)[:-1]
