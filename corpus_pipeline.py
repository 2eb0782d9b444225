"""Corpus pipeline: five stages, each on all documents that its predecessor kept.

quality: failing lines go, documents that the rules reject go; exact: of equal texts the largest id
stays; near: of documents linked by shingles of five words at 0.8 the least id of each group stays;
mix: documents are taken, and repeated, to the sources' target weights; pieces: SentencePiece ids of what
is left, and how the other n best segmentations differ from them, one row per document of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import exact_dedup, jaccard_join, mixing, pieces, quality
from weirflow.llm.common import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("ngram_jaccard", near), ("mix_sources", mix), ("sentencepiece", encode)]

#: The last stage searches a piece lattice, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
