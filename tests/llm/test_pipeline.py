"""The pipeline's stages on a small corpus against plain Python."""

import hashlib
import random
import struct

import pytest
from brute import library

import corpus_pipeline

RNG = random.Random(23)


def _prose(n):
    return " ".join("".join(RNG.choice("aeionrstl") for _ in range(RNG.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    clean = [_prose(120) for _ in range(120)]
    toxic = [_prose(60) + " gruh blek zwop " + _prose(60) for _ in range(30)]
    copies = [clean[0].upper()] * 20
    near = [c + " tail" for c in clean[1:6]]
    texts = clean + toxic + copies + near + [None, "", "😀 é"]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(120 <= i < 150)) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, folder).cache()
        kept[name] = after
        if name != "bpe":
            assert after.columns == docs.columns
        before = after
    ids = {k: sorted(r["doc_id"] for r in v.collect()) for k, v in kept.items()}
    everything = set(range(docs.count()))
    assert set(ids["toxicity"]) == everything - set(range(120, 150))
    # clean[0] and its 20 copies: the largest id stays; null and empty are equal
    assert set(ids["toxicity"]) - set(ids["exact_dedup"]) == {0, *range(150, 169), 175}
    # clean[1..5] and their near copies: the smaller id stays
    assert set(ids["exact_dedup"]) - set(ids["near_dedup"]) == set(range(170, 175))
    assert set(ids["mixing"]) <= set(ids["near_dedup"]) and max(map(ids["mixing"].count, ids["mixing"])) <= 2
    assert ids["bpe"] == ids["mixing"]

    plain = library().encode_ordinary
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in kept["bpe"].collect():
        tokens = plain(text[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(tokens)}I", *tokens)).hexdigest()

    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, kept["bpe"].collect()))


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
