"""A corpus pipeline of four stages over `documents`: language, toxicity, near copies, packing.

Each stage takes what its predecessor kept and returns the rows that it keeps, with the columns
of `documents`; the last one returns the packed pieces. `run` writes every stage to the shared
folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsloom.llm import language_id, packing, toxicity, weighted_minhash
from dnsloom.llm.common import id_remainder
from dnsloom.operators.staging import stage

# A text whose best language explains less than this share of its letters is no known language.
LEAST_LANGUAGE_SCORE = 0.25
LEAST_TOXIC_SCORE = 0.5
# Most texts that a Python worker is handed at once: texts may be long, and the workers of
# several stages share an executor's memory. Set for the session, as plans read it when they run.
TEXTS_PER_BATCH = 2000
# Words that a packing worker keeps, for the same reason.
CACHED_WORDS = 300_000


def _short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a known language: no letters, or hardly any known trigram.

    The filter is learned from this stage's own input, outside the held-out fold. Without a
    row to learn from there is no known language, and nothing is rejected.
    """
    _short_batches(spark)
    model = language_id.train(docs.where(id_remainder("doc_id", 5) != 0))
    if not model.languages:
        return docs
    found = language_id.language_of(spark, model, F.col("text"))
    known = (found["lang_pred"] != language_id.UNKNOWN) & (found["score"] >= LEAST_LANGUAGE_SCORE)
    return docs.where(known)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents."""
    _short_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return docs.where(toxicity.toxicity_of(spark, model, F.col("text")) < LEAST_TOXIC_SCORE)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id.

    Rows that repeat an id are one document; rows without an id are all kept.
    """
    _short_batches(spark)
    found = weighted_minhash.near_duplicates(docs)
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept"))
    named = docs.join(kept.distinct(), F.col("doc_id") == F.col("__kept"), "left_semi")
    return named.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    import public_tokenizers

    _short_batches(spark)
    settings = packing.PackSettings(cached_words=CACHED_WORDS)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.token_pieces(docs, tokenizer, settings), settings)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", clean),
    ("near_copies", distinct),
    ("packing", packed),
]

# No stage can be stated in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}").df
    return docs
