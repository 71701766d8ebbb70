"""One query per operator over the whole shared tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm import (
    exact_dedup, hard_negatives, language_id, lexical_search, line_dedup, mixing, paragraph_dedup, piece_sampling, pitman_yor, quality, set_join, token_files,
    warc,
)
from barwise.llm.common import documents, tokenizer_path, word_count
from barwise.session import materialize, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes from every document."""
    counted = documents(spark, folder).select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    counted = materialize(counted, "mix-sizes")
    mixed = mixing.mix(counted, F.col("size"), counted=counted)
    taken = mixed.groupBy("row").agg(F.sum("mix_size").alias("taken"))
    goal = mixing.targets(counted.select("source", "size")).withColumnRenamed("source", "_s")
    out = counted.join(goal, F.col("source").eqNullSafe(F.col("_s"))).join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


@query
def op2_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under the model and under smoothed word frequencies."""
    return pitman_yor.score(documents(spark, folder))


@query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place, length and checksum of every document, read back from the written token files."""
    target = new_path(spark, "token-ids")
    files = token_files.write(documents(spark, folder), target, tokenizer_path("byte_bpe_50k.json"))
    return token_files.document_index(files, target)


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; a fifth of the documents is never learned from."""
    return language_id.identify(documents(spark, folder))


@query
def op5_set_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under Jaccard links of its word triples."""
    return set_join.join(documents(spark, folder), count_links=False)


@query
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Page texts without the boilerplate lines of their site."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return line_dedup.drop_boilerplate(pages, line_dedup.lines_of_html(F.col("html")), line_dedup.host_of(F.col("url")))


@query
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Group and fate of every document; the largest id of equal texts stays."""
    return exact_dedup.groups(documents(spark, folder), keep="largest")


@query
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Repetition figures and verdict of every document."""
    return quality.score(documents(spark, folder))


@query
def op9_piece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled pieces of every document and whether they decode to its text."""
    return piece_sampling.sample(documents(spark, folder), tokenizer_path("piece_bpe_32k.model"))


@query
def op10_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of documents that repeat in other documents, and which of them go."""
    return paragraph_dedup.repeats(documents(spark, folder))


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hardest rows of other labels for every anchor and positive."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, label=moved, scale=256.0)


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents of every benchmark item."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return lexical_search.search(documents(spark, folder), items)


@query
def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Type and reference of every page's record, read back from the archives."""
    target = new_path(spark, "archives")
    files = warc.write(spark.read.parquet(f"{folder}/pages.parquet"), target)
    records = materialize(warc.read(files, target), "archive-records")
    return warc.resolved(records).drop("url")
