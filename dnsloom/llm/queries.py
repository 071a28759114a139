"""Registered queries of the numbered operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsloom.llm import (
    blocked_search,
    byte_bpe,
    chat_format,
    decontamination,
    exact_topk,
    language_id,
    packing,
    pivot_dedup,
    prefix_trie,
    quality_trees,
    recurrent_lm,
    toxicity,
    weighted_minhash,
)
from dnsloom.llm.common import id_remainder, short_batches
from dnsloom.llm.oracle import ORACLE


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity score of every text."""
    docs = _table(spark, folder, "documents")
    model = toxicity.train(docs, _table(spark, folder, "labels"))
    scored = docs.select(
        "doc_id",
        (id_remainder("doc_id", 5) == 0).alias("held_out"),
        toxicity.toxicity_of(spark, model, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded again; digests of the ids and of the bytes."""
    import public_tokenizers

    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, folder, "documents")
    coded = byte_bpe.encode(docs, vocab, public_tokenizers.PATTERN, at_spaces=True, decoded=True)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_pivot_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings with equal labels and a cosine of 0.93 or more."""
    return pivot_dedup.near_duplicates(_table(spark, folder, "embeddings"))


def op4_recurrent_lm(spark: SparkSession, folder: str) -> DataFrame:
    """The log-likelihood of every text, learned outside remainder 2 of 7."""
    remainder = id_remainder("doc_id", 7)
    docs = _table(spark, folder, "documents")
    scored = recurrent_lm.score(docs, remainder != 2)
    held_out = (remainder == 2).alias("held_out")
    numbers = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return scored.select("doc_id", held_out, *numbers)


def op5_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best inner products for each row whose id is divisible by 100."""
    return exact_topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts hold marks, formatted and read back."""
    said = "\\### Assistant: </turn> ok"
    extra = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    kinds = "conv_id long, turn long, role string, text string"
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(extra, kinds))
    record = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    turns = chat_format.canonical_turns(rows.select("conv_id", record.alias("record")))
    return chat_format.digests(chat_format.format_turns(turns))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every text."""
    docs = _table(spark, folder, "documents")
    model = quality_trees.train(docs, _table(spark, folder, "labels"))
    scored = docs.select(
        "doc_id",
        (id_remainder("doc_id", 5) == 0).alias("held_out"),
        quality_trees.quality_of(spark, model, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every text, learned outside the held-out fold."""
    docs = _table(spark, folder, "documents")
    model = language_id.train(docs.where(id_remainder("doc_id", 5) != 0))
    found = language_id.language_of(spark, model, F.col("text"))
    held_out = (id_remainder("doc_id", 5) == 0).alias("held_out")
    return docs.select("doc_id", held_out, found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )


def op9_weighted_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near-duplicate documents of each document, and whether it stays."""
    short_batches(spark)
    return weighted_minhash.near_duplicates(_table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    settings = packing.PackSettings()
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.token_pieces(_table(spark, folder, "documents"), tokenizer, settings)
    return packing.pack(pieces, settings)


def op11_blocked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty best documents for each benchmark item."""
    return blocked_search.ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The words of each document that lie in passages of ten words of a benchmark item."""
    found = decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.withColumn("items_sha256", digest).drop("items")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all conversations, the first turns of each taken from its hundred's first."""
    rows = _table(spark, folder, "conversations")
    turns = prefix_trie.ordered_turns(rows, "conv_id", "turn", "role", "text")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    return prefix_trie.trie(prefix_trie.spliced(turns, F.col("conv") - F.col("conv") % 100, head))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_pivot_dedup": op3_pivot_dedup,
    "op4_recurrent_lm": op4_recurrent_lm,
    "op5_exact_topk": op5_exact_topk,
    "op6_chat_format": op6_chat_format,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_weighted_minhash": op9_weighted_minhash,
    "op10_packing": op10_packing,
    "op11_blocked_search": op11_blocked_search,
    "op12_decontamination": op12_decontamination,
    "op13_prefix_trie": op13_prefix_trie,
}

__all__ = ["ORACLE", "QUERIES"]
