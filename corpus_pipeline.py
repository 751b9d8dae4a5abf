"""The corpus pipeline: toxic documents out, exact and near copies out, sources mixed, tokens encoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, exact_dedup, mixing, simhash, toxicity
from quernstone.llm.common import batches_of, cut, fresh, quoted, shared_folder, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score as toxic.

    Learns from the labelled ones (table labels, not the held-out ids). Null and empty texts and texts without known words get the base rate and stay; very long
    texts are scored whole; each row is judged by its own text, so ties, repeated rows and null ids don't matter. An empty table gives an empty result. All columns stay,
    also those named toxicity, toxic or evidence.
    """
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = fresh(docs, "row")
    rows = docs.select(F.col("text"), F.struct(*quoted(docs)).alias(held))  # columns named like the scores stay as they are
    return toxicity.score_toxicity(rows, index).where("toxic = 0").select(f"{held}.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (A-Z lower-cased), the one of the largest id.

    Null and empty texts are equal. Rows are known by id and text: of repeated rows one stays, a null or repeated id takes no other text along. Very long texts are
    hashed whole. An empty table gives an empty result. All columns stay, whatever their names.
    """
    return exact_dedup.drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, Jaccard likeness 0.8 or more), the one of the smallest id.

    Null, empty and blank texts are copies of each other. Rows are known by id and text: of repeated rows one stays, a null or repeated id takes no other
    text along. Whole texts are compared. An empty table gives an empty result. All columns stay, whatever their names.
    """
    return simhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as the mix of the sources takes them: whole, once for each pass.

    A null source is a source. Null and empty texts have no words and go with the rows around them. Repeated rows come and go together; a null id is an id. Each source
    misses its target by at most half a document. An empty table gives an empty result. All columns stay, whatever their names.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: id, number of tokens, and hashes of the ids and of the bytes that they decode to.

    Null counts as empty and has no tokens. Very long texts are encoded whole, repeated rows each time. An empty table gives an empty result. Further columns are left out.
    Tasks get few texts at once, as those of a batch are held several times over; batches are settled when the stage is planned, so it ends with a checkpoint of its short rows.
    """
    with batches_of(spark, bpe.ROWS):
        return cut(bpe.digests(docs))


STAGES = [("toxicity", toxicity_filter), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: SQL expresses neither the fingerprints nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet to the shared checkpoint folder and read again."""
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared}/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
