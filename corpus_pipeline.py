"""A corpus from documents to packed sequences: five of the operators in turn.

Each stage takes (spark, docs, sf_dir), docs being all rows that the stage before kept, and returns the columns of
documents (doc_id, text, lang, source, n_chars); the last returns pieces placed in sequences. Empty tables pass
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm import language_id, minhash_forest, mixing, packing, suffix_dedup
from oddsmill.llm.common import growing

#: Bytes of a repeat: fifty words of five bytes each, so that a passage of over fifty words is cut wherever it stands again.
REPEAT_BYTES = 250
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null texts, texts without letters, scores under one half."""
    return language_id.accepted(docs.select(*COLUMNS), language_id.train_on_fold(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity of 0.8), the one with the least id.

    Repeated rows of an id are one document; rows with a null id stay, since nothing tells them apart.
    """
    docs = docs.select(*COLUMNS)
    found = minhash_forest.near_duplicates(docs)
    kept = found.where("doc_id is not null and kept").select("doc_id").distinct()
    return docs.join(growing(kept), "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the long strings that occur again elsewhere; documents stay, with what is left of them."""
    out = suffix_dedup.remove_repeats(docs, carry=["lang", "source"], length=REPEAT_BYTES)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a document taken twice is two rows."""
    docs = docs.select(*COLUMNS)
    mixed = mixing.mix(docs).groupBy("doc_id", "source").agg(F.max("copies").alias("_copies")).where("_copies > 0")
    mixed = mixed.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "_copies")
    taken = docs.join(growing(mixed), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", tell_language),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("pattern_packing", pack_sequences),
]

#: SQL can't express piece probabilities, sketches or packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
