"""The registered queries: each applies its operator, with production parameters, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.llm import chat, html_text, langid, licenses, neardup, oracles, packing, pieces, quality, token_files, topk
from lumenscan.llm._common import read, written


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizers keep a file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


def op4_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return topk.top_k(e, e.where("vec_id % 50 = 0"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_documents(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_matches", F.concat_ws(",", "licenses").alias("licenses"), F.round("best", 6).alias("best"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(chat.format_conversations(chat.with_control_conversation(read(spark, sf_dir, "conversations"))))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(read(spark, sf_dir, "documents"), token_files.TokenFileOptions(tokenizer_path("byte_bpe_50k.json")))


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), neardup.NearDupOptions(shingle=4))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = packing.pack_documents(read(spark, sf_dir, "documents"), packing.PackingOptions(tokenizer_path("byte_bpe_50k.json")))
    return packing.piece_table(written(bins, "bins"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_table(read(spark, sf_dir, "documents"), pieces.PieceOptions(tokenizer_path("piece_bpe_32k.model")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_quality_divergence, op2_language_id, op3_html_text, op4_cover_tree_top_k, op5_license_scan, op6_chat_format, op7_token_files, op8_minhash_near_duplicates, op9_best_fit_packing, op10_sentencepiece, pipeline]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_divergence": oracles.quality_sql(),
        "op4_cover_tree_top_k": oracles.TOP_K_SQL,
        "op6_chat_format": oracles.CHAT_SQL,
        "op8_minhash_near_duplicates": oracles.NEAR_DUPLICATE_SQL,
    }
