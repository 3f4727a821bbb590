"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlens.llm import (
    conversation_repair,
    golay_simhash,
    kneser_ney,
    language_id,
    line_dedup,
    packing,
    piece_counts,
    piece_viterbi,
    prefix_trie,
    projection_neighbours,
    quality_model,
    quality_rules,
    token_store,
)
from unitlens.llm.storage import saved, shared_path, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.bucket("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    slots = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return slots.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_projection_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    encoded = piece_viterbi.encode(docs, model).withColumn("n_tokens", F.octet_length("ids").cast("long") / 4) \
        .withColumn("ids_crc32", F.crc32("ids"))
    return piece_viterbi.decode(encoded, model).select(
        "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32",
        (F.xxhash64("text") == F.col("hash")).alias("round_trip"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.bucket("doc_id", 5) == 0
    model = quality_model.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality_model.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document: the component it is in, where its first occurrence is, and whether it stays."""
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op9_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golay_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.bucket("doc_id", 5) == 1
    model = kneser_ney.fit(docs.where(~held_out))
    return kneser_ney.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=("doc_id", "held_out"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(turns), turns)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, lengths = prefix_trie.regrafted(saved(prefix_trie.placed(table(spark, sf_dir, "conversations")), "placed"))
    return prefix_trie.trie(turns, lengths)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_projection_neighbours": op3_projection_neighbours,
    "op4_token_store": op4_token_store,
    "op5_piece_viterbi": op5_piece_viterbi,
    "op6_quality_model": op6_quality_model,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_piece_counts": op9_piece_counts,
    "op10_golay_simhash": op10_golay_simhash,
    "op11_kneser_ney": op11_kneser_ney,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_prefix_trie": op13_prefix_trie,
}
