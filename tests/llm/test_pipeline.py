"""The pipeline's stages take effect."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline as p
    from reelgraph.llm import secrets
    from tests.llm.test_dedup import brute_fingerprint, words_of

    out = p.run(spark, DATA).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    assert out and len({r["doc_id"] for r in out}) == len(out) and all(r["round_trip"] for r in out)
    prints = [brute_fingerprint(docs[r["doc_id"]]) for r in out]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    scanner, codec = secrets.Scanner(), p.vocabulary(spark).codec()
    for r in out:
        w = words_of(docs[r["doc_id"]])
        assert not any(tuple(w[i : i + n]) in grams for n in range(1, 11) for i in range(len(w) - n + 1))
        text = codec.decode(r["ids"]).decode()
        if not scanner.spans(docs[r["doc_id"]] or ""):
            assert text == (docs[r["doc_id"]] or "")
        else:
            assert text != docs[r["doc_id"]] and "[secret]" in text


def test_near_dedup_keeps_one_document_of_each_component(spark):
    import corpus_pipeline as p
    from tests.llm.test_dedup import brute_fingerprint

    texts = [" ".join(f"{w}{i}" for i in range(12)) for w in ("ant", "bee", "cow", "dog", "elk", "fox", "gnu")]
    ids = [(None, 0), (None, 1), (1, 2), (1, 3), (2, 3), (3, 4), (3, 5), (None, 5), (4, 6), (4, 6), (None, 6)]
    prints = [brute_fingerprint(t) for t in texts]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    docs = spark.createDataFrame([(i, texts[k], "en", "s", len(texts[k])) for i, k in ids], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in p.near_dedup_stage(spark, docs, None).collect()]
    want = [(None, 0), (None, 1), (1, 2), (1, 3), (3, 4), (3, 5), (4, 6)]
    assert sorted(kept, key=str) == sorted([(i, texts[k]) for i, k in want], key=str)
    assert p.near_dedup_stage(spark, docs.limit(0), None).count() == 0
