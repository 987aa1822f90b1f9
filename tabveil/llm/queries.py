"""The registered queries of this package. Each reads whole tables and runs one operator at production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.llm import bpe, chat, decontaminate, mixing, ngram_join, pii, prefix_trie, quality, repair, repeats, tokens, topk, warc
from tabveil.llm.common import new_folder, read_table
from tabveil.llm.oracles import ORACLES

#: Where the public vocabularies are; a parameter of op4 and op12, since they are never copied.
TOKENIZERS = "/opt/tokenizers"

__all__ = ["ORACLES", "QUERIES"]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark")))
    sha = F.sha2(F.array_join("decon_items", ",").cast("binary"), 256)
    return found.select("doc_id", F.col("decon_words").alias("n_words"), F.col("decon_hit").alias("n_hit"), F.size("decon_items").cast("long").alias("n_items"), sha.alias("items_sha256"), "contaminated")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.of_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.jaccard_classes(docs, k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op4_tokens(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, tokens.load_pieces(f"{tokenizers}/piece_bpe_32k.model"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_warc(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.train(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    score = F.col("quality_score")
    return quality.score_quality(docs, field).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(read_table(spark, sf_dir, "conversations"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return repair.repair_report(conversations, repair.damaged(conversations))


def op12_bpe(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    ranks = bpe.load_ranks(f"{tokenizers}/byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks), ranks)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii": op2_pii,
    "op3_ngram_join": op3_ngram_join,
    "op4_tokens": op4_tokens,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_chat": op7_chat,
    "op8_repeats": op8_repeats,
    "op9_topk": op9_topk,
    "op10_mix": op10_mix,
    "op11_repair": op11_repair,
    "op12_bpe": op12_bpe,
    "op13_trie": op13_trie,
}
