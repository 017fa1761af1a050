"""The corpus pipeline, stage by stage, on the smallest data."""

import corpus_pipeline
from parley.llm.jaccard_join import Rule
from tests.llm.test_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs.count()
        if name != "packing":
            assert docs.columns == before.columns and docs.exceptAll(before).count() == 0
        if name == "exact_copies":
            squeezed = {r.doc_id: "".join((r.text or "").split()) for r in before.collect()}
            assert len({squeezed[r.doc_id] for r in docs.collect()}) == seen[name] == len(set(squeezed.values()))
        if name == "near_copies":
            want = brute([(r.doc_id, r.text) for r in before.collect()], Rule(5, 80))
            assert {r.doc_id for r in docs.collect()} == {c for _, c in want.values()}
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    assert seen["quality"] > 150 and seen["language"] >= 0.98 * seen["quality"]
    assert corpus_pipeline.run(spark, SF).count() == seen["packing"]


def test_a_worker_lets_go_of_the_tables_of_earlier_stages(monkeypatch):
    """Python workers go on from stage to stage; packing must not add its tables to those of language."""
    import numpy as np
    import public_tokenizers

    from parley.llm import best_fit, common, lang_unigram

    monkeypatch.setattr(common, "_FORGET", {})
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = lang_unigram.LangModel(["en"], np.full((len(lang_unigram.vocabulary(path)) + 1, 1), 1e-5), path)
    common.hold_alone("lang_unigram", lang_unigram._let_go)
    assert [p[0] for p in lang_unigram.scorer(model).predict(["some words"])] == ["en"]
    assert lang_unigram.trie.cache_info().currsize
    common.hold_alone("best_fit", best_fit.chunk_encoder.cache_clear)
    best_fit.chunk_encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not lang_unigram.trie.cache_info().currsize and not lang_unigram._scorer.cache_info().currsize
    common.hold_alone("best_fit", best_fit.chunk_encoder.cache_clear)
    assert best_fit.chunk_encoder.cache_info().currsize  # its own tables stay from task to task


def test_fewer_remembered_chunks_give_the_same_ids():
    import public_tokenizers

    from parley.llm.best_fit import ChunkEncoder

    texts = [" ".join(f"word{i * j} x{j}" for j in range(30)) for i in range(50)]
    path = public_tokenizers.path("word_bpe_49k.json")
    few = ChunkEncoder(path, remembered=100)
    assert list(few.encode(texts)) == list(ChunkEncoder(path).encode(texts))
    assert len(few.known) < 400
