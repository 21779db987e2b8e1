"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import chat, collocations, contamination, ctw, embeddings, merkle, mixing, packing, pii, quality, simhash, sstable, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sstable.shard_path(spark)
    sstable.write_shards(_table(spark, sf_dir, "documents"), path, sstable.default_tokenizer())
    return sstable.read_digests(spark, path)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.formatted(chat.with_probe(_table(spark, sf_dir, "conversations"))))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}") for k in pii.KINDS[:4]]
    return rows.select("doc_id", *counts, F.sha2(pii.joined(F.col("spans")), 256).alias("base_sha256"), pii.joined(F.concat("spans", "found")).alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.apportion(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_simhash_dedup, op3_quality_rules, op4_token_shards, op5_chat_formatting, op6_embedding_dedup, op7_context_tree, op8_personal_data, op9_packing, op10_source_mixing, op11_phrase_collocations, op12_benchmark_decontamination, op13_merkle_manifest)}
ORACLE_SQL = {"op10_source_mixing": mixing.MIX_SQL, "op11_phrase_collocations": collocations.MINE_SQL, "op12_benchmark_decontamination": contamination.JUDGE_SQL, "op13_merkle_manifest": merkle.audit_sql()}
