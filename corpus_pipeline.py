"""A corpus from raw documents to sampled pieces, one operator per stage.

Every stage is written as Parquet to the shared folder and read again, so a lost executor repeats one stage at most.
Stages before the last return the columns of the documents; the mix may hold a document twice, as two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwise.llm import exact_dedup, mixing, piece_sampling, quality, set_join
from barwise.llm.common import documents, tokenizer_path
from barwise.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.dedup(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id. Links are of five words at 0.8; the query of the join has figures of its own."""
    return set_join.dedup(docs, n=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights."""
    return mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every row of the mix."""
    return piece_sampling.sample(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding", pieces),
]

#: Similarity components, hypergeometric draws and sampled pieces are beyond SQL; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
