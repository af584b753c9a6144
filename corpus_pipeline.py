"""documents -> quality rules -> language ID -> near-duplicate removal -> packed bins.

Each stage reads what the one before wrote; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenscan.llm import langid, neardup, packing, quality
from lumenscan.llm._common import clean, fresh_dir, mark, written
from lumenscan.llm.queries import tokenizer_path


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.filter_documents(docs)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return neardup.filter_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of token ids of all documents; returned are their pieces."""
    # the workers hold the language model too: little is remembered and encoded at once
    options = packing.PackingOptions(tokenizer_path("byte_bpe_50k.json"), memo=150_000, slice_bytes=1 << 20)
    bins = packing.pack_documents(docs, options)
    return packing.piece_table(written(bins, "bins"))


STAGES = [
    ("quality_rules", keep_good_quality),
    ("language_id", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("best_fit_packing", pack_bins),
]
#: Language models and MinHash signatures are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage worked with and what it read is deleted once its result is written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        since = mark() - (path is not None)
        path = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        clean(spark, since, keep=(path,))
        docs = spark.read.parquet(path)
    return docs
