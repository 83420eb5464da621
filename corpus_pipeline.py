"""The corpus pipeline: documents through five operators of lodeframe.llm, near duplicates included.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes every stage's rows as Parquet to the
shared folder and gives the reread rows to the next one. All but the last return the columns of ``documents``; the last
returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import common, decontamination, near_dedup, packing, quality, suffix_dedup


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return quality.keep_good(spark, docs, sf_dir)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, a similarity of 0.8 or more)."""
    return near_dedup.keep_one(spark, docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 100 bytes or more that also start earlier; n_chars is that of what is left."""
    return suffix_dedup.cut_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontamination.clean(spark, docs, sf_dir)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 token ids."""
    return packing.pack(docs, common.tokenizer_path(), with_ids=False).drop("ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: Tokenizers and the classifier's noise have no counterpart in SQL; the tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "stage")
    return docs
