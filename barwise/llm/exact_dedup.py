"""Exact dedup: rows grouped by a 128-bit hash of the normalised text, groups checked byte for byte.

Only fingerprints are shuffled to form the groups, and counts combine before the shuffle, so a group that
holds a third of all rows is one row per map task. Texts move only for groups of two and more: the smallest
and the largest text of a group are compared, and both combine before the shuffle as well. A group in which
they differ holds a hash collision and is split by the SHA-256 of its texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.llm import links
from barwise.llm.common import lower_ascii, unused
from barwise.session import materialize


def normalised(text: str = "text") -> Column:
    return F.coalesce(lower_ascii(F.col(text)), F.lit(""))


def content_hash(norm: Column) -> Column:
    """128 bits of MD5."""
    return F.md5(F.encode(norm, "UTF-8"))


def _fingerprints(docs: DataFrame, doc_id: str, text: str, hashed: Callable[[Column], Column]) -> DataFrame:
    """One row per document: id, hash, SHA-256 and a row number that stays the same once written."""
    norm = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(text).alias("norm"))
    return norm.select(
        "doc_id",
        hashed(F.col("norm")).alias("hash"),
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"),
    )


def groups(
    docs: DataFrame,
    keep: str = "smallest",
    doc_id: str = "doc_id",
    text: str = "text",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` says whether the smallest or the largest id of a group stays. A null text counts as empty. Rows
    that repeat an id and its text count one by one, and exactly one row of a group is kept. A null id ranks
    behind all others: it stays only where the group has no id, and ``keep_id`` is null then. An empty table
    gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    prints = materialize(_fingerprints(docs, doc_id, text, hashed), "fingerprints")
    repeated = prints.groupBy("hash").count().where(F.col("count") > 1).select("hash")
    texts = docs.select(normalised(text).alias("norm"), F.col(doc_id).cast("long").alias("doc_id"))
    suspects = texts.withColumn("hash", hashed(F.col("norm"))).join(repeated, "hash")
    mixed = suspects.groupBy("hash").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    mixed = materialize(mixed.where(F.col("low") != F.col("high")).select("hash"), "collisions")
    split = prints.join(mixed.withColumn("collided", F.lit(True)), "hash", "left")
    named = split.withColumn("part", F.when(F.col("collided"), F.col("text_sha256")).otherwise(""))
    # Ids rank first, then the row; the sign turns the order around for "smallest".
    sign = 1 if keep == "largest" else -1
    rank = F.struct((F.col("doc_id") * sign).alias("r"), (-F.col("row")).alias("row"))
    best = named.groupBy("hash", "part").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    out = named.join(best, ["hash", "part"])
    return out.select(
        "doc_id",
        (F.col("best.r") * sign).alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame, keep: str = "smallest", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is recognised by id and text. Of rows that repeat both, one stays; which one is open where their
    further columns differ.
    """
    decided = groups(docs, keep, doc_id, text)
    own, sha, stays, n, row = unused(docs, "own_id", "own_sha", "stays", "copies", "whole_row")
    by_row = decided.groupBy(F.col("doc_id").alias(own), F.unhex("text_sha256").alias(sha))
    by_row = by_row.agg(F.max("kept").alias(stays), F.count(F.lit(1)).alias(n)).where(~F.col(stays) | (F.col(n) > 1))
    by_row = materialize(by_row, "dropped-rows")
    # Few rows go, so texts stay where they are: a shuffle of them would also lie on disk for as long as the result is in use.
    text_sha = F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(own)) & (text_sha == F.col(sha))
    single = docs.join(links.broadcast_small(by_row.select(own, sha)), same, "left_anti")
    several = docs.join(links.broadcast_small(by_row.where(F.col(stays))), same)
    one = several.groupBy(own, sha).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(row))
    return single.unionByName(one.select(f"{row}.*"))
