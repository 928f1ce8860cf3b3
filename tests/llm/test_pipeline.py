import zlib

import corpus_pipeline
from touchline.llm import op01_quality, op04_packing, op05_line_dedup, op09_decontamination, op10_simhash

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before = {r.doc_id: r for r in docs.collect()}
        if name == "packing":
            break
        after = {r.doc_id: r for r in out.collect()}
        assert out.columns == docs.columns and after.keys() <= before.keys()
        if name == "quality":
            weights = op01_quality.fit(docs, labels)
            score = op01_quality.score_texts([(r.text or "").encode() for r in before.values()], weights)
            assert after.keys() == {i for i, s in zip(before, score, strict=True) if s >= op01_quality.THRESHOLD}
        elif name == "line_dedup":
            kept = {r.doc_id: r.text for r in op05_line_dedup.dedup_lines(docs).collect()}
            assert {i: r.text for i, r in after.items()} == kept
        elif name == "near_dedup":
            groups = {r.doc_id: r.component_id for r in op10_simhash.near_duplicates(docs).collect()}
            assert after.keys() == set(groups.values()) and len(after) < len(before)
        else:
            bad = {r.doc_id for r in op09_decontamination.leaks(docs, items).collect()}
            assert bad and after.keys() == before.keys() - bad
        docs = out
    pieces = {}
    for r in out.collect():
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length and r.offset == 0
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    memo = op04_packing.WordIds(op04_packing.default_tokenizer())
    for i, r in before.items():
        words = (r.text or "").encode().split()
        memo.learn(set(words))
        assert b"".join(d for _, d in sorted(pieces[i])) == b"".join(memo[w] for w in words) + (2).to_bytes(4, "little")


def test_odd_rows_pass_all_stages(spark, tmp_path):
    odd = [(None, "no id here", "en", "s", 10), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 60_000, "en", "s", 300_000), (4, "same text", "en", "a", 9), (4, "same text", "en", "b", 9), (5, "same text", "en", "b", 9)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert {r.doc_id for r in docs.collect()} == {None, 1, 3, 4} or {r.doc_id for r in docs.collect()} == {1, 3, 4, None}
    clash = spark.createDataFrame([(i, "the same long line in all three\nrow " + "xyz"[i], *range(8)) for i in range(3)], "doc_id long, text string, n_lines int, n_dropped int, m_doc_id int, M_hash int, fp int, score int, c_id int, __bytes int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, clash, SF)
        assert after.columns == clash.columns
        assert all(tuple(r)[2:] == tuple(range(8)) for r in after.collect())
    cut = corpus_pipeline.line_dedup(spark, clash, SF)
    assert sorted(r.text for r in cut.collect()) == ["row x", "row y", "the same long line in all three\nrow z"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
