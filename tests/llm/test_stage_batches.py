"""How many texts the last stage of the pipeline hands to its tasks at once."""

import corpus_pipeline
from quernstone.llm import bpe


def test_encoding_gets_few_texts_at_once(spark, monkeypatch):
    key, seen, cut = "spark.sql.execution.arrow.maxRecordsPerBatch", [], corpus_pipeline.cut
    monkeypatch.setattr(corpus_pipeline, "cut", lambda df: (seen.append(spark.conf.get(key)), cut(df))[1])
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(i, None if i % 9 == 0 else f"text {i} en meer") for i in range(700)], "doc_id long, text string").coalesce(1)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(corpus_pipeline.encode(spark, docs, "")) == rows(bpe.digests(docs))
    assert seen == [str(bpe.ROWS)] and spark.conf.get(key) == before
