"""Substring dedup by paragraphs: MinHash bands for lines, selected windows for passages inside lines.

A paragraph is a line of at least ``LEAST`` words, or a window of ``LEAST`` words chosen by its hash (the
smallest of ``LEAST`` neighbouring windows), so any passage of 2 * LEAST - 1 words that two documents share has a chosen
window in common, wherever it stands. Equal paragraphs are one node. Lines are banded by MinHash over runs of five words; bands are
tuned for the wanted recall at the threshold. Lines that meet in a band are verified by exact Jaccard and become
components (see ``links``). In each component the occurrence in the smallest document stays, the others are removals.

Only hashes and positions are shuffled. Texts are read a second time for lines that met in a band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.llm import links
from barwise.llm.common import lower_words_of, map_arrow, unused
from barwise.llm.set_join import _mixed, ngram_hashes, word_hashes
from barwise.session import materialize

LEAST, WORDS, PERCENT, RECALL = 26, 5, 80, 0.995
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
PARTS = "doc_id long, row long, start int, n int, h1 long, h2 long, bands array<long>"
SETS = "h1 long, h2 long, tokens array<long>, parity array<long>"


def tune(percent: int = PERCENT, recall: float = RECALL, most: int = 72) -> tuple[int, int]:
    """Bands and rows per band: the most selective ones (most rows) that find the wanted part of pairs at the threshold
    with at most ``most`` hash functions."""
    t = percent / 100
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - t**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


class Lines:
    """The words of a batch of texts, end to end: hashes, and for every line that is a paragraph its text, place and size.

    Words are lower-cased (A-Z) and cut at white space, lines at line feeds.
    """

    def __init__(self, texts: list[str | None]):
        words: list[bytes] = []
        sizes, owner, starts, totals = [], [], [], []
        for i, text in enumerate(texts):
            before = len(words)
            for line in (text or "").split("\n"):
                found = lower_words_of(line)
                if len(found) >= LEAST:
                    sizes.append(len(found))
                    owner.append(i)
                    starts.append(len(words))
                words += found
            totals.append(len(words) - before)
        self.hashes = word_hashes(words)
        self.sizes, self.owner, self.starts = (np.array(x, dtype=np.int64) for x in (sizes, owner, starts))
        self.stops = np.cumsum(np.array(totals, dtype=np.int64))
        self.firsts = self.stops - np.array(totals, dtype=np.int64)

    def identity(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of every line."""
        at = _spread(self.starts, self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        place = _mixed((np.arange(len(at)) - np.repeat(first, self.sizes)).astype(np.uint64) * _P)
        own = self.hashes[at]
        return tuple(np.add.reduceat(x, first).astype(np.int64) for x in (_mixed(own ^ place), _mixed(own * _P + place)))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram hashes of all lines, end to end, and their number per line."""
        counts = self.sizes - WORDS + 1
        return ngram_hashes(self.hashes, WORDS)[_spread(self.starts, counts)], counts

    def bands(self, bands: int, rows: int) -> np.ndarray:
        """The band keys of all lines. A hash function is one multiplication, as n-gram hashes are mixed already."""
        grams, counts = self.grams()
        first = np.cumsum(counts) - counts
        seeds = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * _P)
        keys = np.empty((len(counts), bands), dtype=np.uint64)
        for b in range(bands):
            key = np.full(len(counts), b, dtype=np.uint64)
            for s in seeds[b * rows : (b + 1) * rows]:
                key = _mixed(key * _P + np.minimum.reduceat((grams ^ s) * (s | np.uint64(1)), first))
            keys[:, b] = key
        return keys.astype(np.int64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all stretches, end to end."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _fold(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window of ``LEAST`` words."""
    n = len(hashes) - LEAST + 1
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(LEAST):
        a = a * _P + hashes[k : k + n]
        b = (b + hashes[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
    return _mixed(a), _mixed(b)


def chosen(hashes: np.ndarray) -> np.ndarray:
    """Positions of windows that are the smallest among ``LEAST`` neighbours; of equal ones in a row the first."""
    if len(hashes) <= LEAST:
        return np.array([int(np.argmin(hashes))]) if len(hashes) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, LEAST)
    at = np.unique(np.argmin(view, axis=1) + np.arange(len(view)))
    return at[np.concatenate([[True], hashes[at][1:] != hashes[at][:-1]])]


def _paragraphs(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """All paragraphs with their place in words and their hashes; bands are null for windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PARTS.split(", ")]
        for batch in batches:
            ids, row = batch.column(0), batch.column(1)
            lines = Lines(batch.column(2).to_pylist())
            if len(lines.sizes):
                keys = lines.bands(bands, rows)
                lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * bands, pa.array(keys.reshape(-1)))
                at, place = pa.array(lines.owner), (lines.starts - lines.firsts[lines.owner]).astype(np.int32)
                columns = [pa.array(place), pa.array(lines.sizes.astype(np.int32)), *map(pa.array, lines.identity()), lists]
                yield pa.RecordBatch.from_arrays([ids.take(at), row.take(at), *columns], names)
            if len(lines.hashes) < LEAST:
                continue
            a, b = _fold(lines.hashes)
            picks, owner = [], []
            for i, (low, high) in enumerate(zip(lines.firsts.tolist(), lines.stops.tolist(), strict=True)):
                if high - low >= LEAST:
                    picks.append(chosen(a[low : high - LEAST + 1]) + low)
                    owner.append(np.full(len(picks[-1]), i))
            if not picks:
                continue
            pick, owner = np.concatenate(picks), np.concatenate(owner)
            at, none = pa.array(owner), pa.nulls(len(pick), pa.list_(pa.int64()))
            columns = [pa.array((pick - lines.firsts[owner]).astype(np.int32)), pa.array(np.full(len(pick), LEAST, np.int32))]
            columns += [pa.array(a[pick].astype(np.int64)), pa.array(b[pick].astype(np.int64)), none]
            yield pa.RecordBatch.from_arrays([ids.take(at), row.take(at), *columns], names)

    return map_arrow(docs.select("doc_id", "row", "text"), run, PARTS)


def _line_sets(docs: DataFrame) -> DataFrame:
    """The n-gram sets of all lines that are paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = Lines(batch.column(0).to_pylist())
            if not len(lines.sizes):
                continue
            grams, counts = lines.grams()
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((grams, owner))
            grams, owner = grams[order], owner[order]
            new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])
            stops = np.cumsum(np.bincount(owner[new], minlength=len(counts)))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], stops]).astype(np.int32), pa.array(grams[new].astype(np.int64)))
            parity = links.parities(grams[new], np.bincount(owner[new], minlength=len(counts)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, lines.identity()), lists, parity], ["h1", "h2", "tokens", "parity"])

    return map_arrow(docs.select("text"), run, SETS)


def repeats(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stretches of documents that repeat in other documents: ``doc_id, start_word, end_word, n_words, kept_in, removed``.

    Words count over the whole text from 0, ``end_word`` is exclusive; overlapping paragraphs of one fate are one
    stretch. ``removed`` is false for the occurrence that stays, in the smallest id; ``kept_in`` names the smallest such id.
    Documents without repeated paragraphs have no row, so a null or empty text has none. A null id ranks last. Rows that
    repeat an id are documents of their own. An empty table gives an empty result.
    """
    bands, per_band = tune(percent, recall)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    parts = materialize(_paragraphs(rows, bands, per_band), "paragraphs")
    # Lines: nodes are distinct lines that meet another line in a band.
    lines = parts.where(F.col("bands").isNotNull())
    nodes = lines.groupBy("h1", "h2").agg(F.min(F.struct("row", "start")).alias("first"))
    heads = lines.join(nodes, ["h1", "h2"]).where((F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start")))
    heads = heads.select("doc_id", "h1", "h2", "n", "bands", F.monotonically_increasing_id().alias("node"))
    heads = materialize(heads, "line-nodes")
    keys = heads.select(F.explode("bands").alias("key"), "node")
    meet = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("key")
    keys = materialize(keys.join(meet, "key"), "met-bands")
    met = heads.join(keys.select("node").distinct(), "node", "left_semi").select("doc_id", "h1", "h2", "node")
    met = materialize(met, "met-lines")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ids = links.broadcast_small(materialize(met.select(F.col("doc_id").alias("_id")).distinct(), "met-documents"))
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = _line_sets(texts).join(links.broadcast_small(met).drop("doc_id"), ["h1", "h2"]).dropDuplicates(["node"])
    sets = materialize(sets.select("node", "tokens", "parity", F.size("tokens").alias("n")), "line-sets")
    buckets = materialize(keys.join(sets.select("node", "n"), "node").withColumn("few", F.lit(0)), "bucket-rows")
    _, joined = links.link(buckets, sets.select("node", "tokens", "parity"), percent)
    near = heads.join(joined, "node").select("h1", "h2", "component")
    near = lines.join(near, ["h1", "h2"], "left").select(
        "doc_id", "row", "start", "n", F.when(F.col("component").isNull(), F.struct("h1", "h2")).otherwise(F.struct(F.col("component").alias("h1"), F.lit(0).cast("long").alias("h2"))).alias("cluster"),
        F.lit(True).alias("line"),
    )
    windows = parts.where(F.col("bands").isNull()).select("doc_id", "row", "start", "n", F.struct("h1", "h2").alias("cluster"), F.lit(False).alias("line"))
    every = near.unionByName(windows)
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row", "start")
    groups = every.groupBy("line", "cluster").agg(F.min(place).alias("first"), F.min("row").alias("low"), F.max("row").alias("high"))
    groups = groups.where(F.col("low") < F.col("high")).select("line", "cluster", "first")
    found = every.join(groups, ["line", "cluster"]).select(
        "doc_id", "row", "start", (F.col("start") + F.col("n")).alias("stop"), F.col("first.doc_id").alias("kept_in"),
        ((F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start"))).alias("removed"),
    )
    ahead = Window.partitionBy("row", "removed").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    sofar = Window.partitionBy("row", "removed").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("new", F.when(F.col("start") <= F.max("stop").over(ahead), 0).otherwise(1))
    found = found.withColumn("stretch", F.sum("new").over(sofar))
    merged = found.groupBy("doc_id", "row", "removed", "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("kept_in").alias("kept_in"))
    return merged.select(
        "doc_id", F.col("start").cast("long").alias("start_word"), F.col("stop").cast("long").alias("end_word"),
        (F.col("stop") - F.col("start")).cast("long").alias("n_words"), "kept_in", "removed",
    )


def cut(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the removed stretches of ``found``; the white space before a removed word goes with it.

    Null texts stay null; documents without removals, and all where ``found`` is empty, stay as they are. Stretches of a null id are cut from
    every row without an id. Rows that repeat an id are cut alike, so give texts that repeat an id one by one.
    """
    own, spans = unused(docs, "cut_id", "cut_spans")
    gone = found.where("removed").groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans))
    joined = docs.join(gone, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(own)), "left")

    def without(texts, gone):
        import re

        import pandas as pd

        word = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")

        def one(t, spans):
            if t is None or spans is None:
                return t
            ends, last = [0], 0
            for m in word.finditer(t):
                ends.append(last := m.end())
            cutout = sorted((ends[s["start_word"]], ends[min(s["end_word"], len(ends) - 1)]) for s in spans)
            out, at = [], 0
            for a, b in cutout:
                out.append(t[at : max(a, at)])
                at = max(at, b)
            return "".join(out) + t[at:]

        return pd.Series([one(t, s) for t, s in zip(texts, gone, strict=True)], dtype=object)

    return joined.withColumn(text, F.pandas_udf(without, "string")(F.col(f"`{text}`"), F.col(spans))).drop(own, spans)
