"""Jaccard self-join of documents on word n-grams: a size-aware heavy-light join.

1. A document is the set of its distinct n-grams as 64-bit hashes. Documents with equal sets form a class
   (128-bit hash of the set) and go on as one.
2. Sets that reach the threshold share all but a few elements, so they share ``c`` of the first ones in any common order
   when the prefix is ``c`` longer than what may be missing. Frequent elements come last in the order: they are found by
   counting the first elements, some ``SPARE`` more than a prefix needs, so that a prefix can be made up without the
   frequent ones. Only sets with too many frequent elements are read as a whole for that.
3. Small sets are joined on all subsets of two prefix elements, which hardly ever meet by chance; large sets, whose subsets
   would be many, on the inverted lists of single prefix elements. The boundary is the size with the least cost, rows written
   plus candidates met. Sets up to the boundary divided by the threshold are on the small side as well, so pairs across are met.
4. Candidates are verified on the whole sets, links become components, and the links within each are counted (see ``links``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.llm import links
from barwise.llm.common import lower_words_of, map_arrow, unused
from barwise.session import discard, materialize

WORDS, PERCENT = 3, 90
#: From so many sets on an element is frequent and moves to the end of the order.
FREQUENT = 64
#: Elements kept beyond those of a prefix.
SPARE = 64
#: Cost of a candidate met in an inverted list, in rows written.
PER_CANDIDATE = 2.0
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
PRINTS = "doc_id long, row long, n int, h1 long, h2 long, few int, prefix array<long>"
SETS = "doc_id long, row long, n int, h1 long, h2 long, few int, tokens array<long>"
MAPS = "doc_id long, row long, n int, h1 long, h2 long, few int, parity array<long>, wide array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, by polynomial over their bytes; equal words, equal hash."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(first, sizes)
    longest = int(sizes.max()) if len(sizes) else 0
    powers = np.ones(longest, dtype=np.uint64)
    if longest > 1:
        powers[1:] = np.cumprod(np.full(longest - 1, _P))
    sums = np.add.reduceat(_mixed(data * powers[place] + np.uint64(0x2545F4914F6CDD1D)), first) if len(data) else np.zeros(0, np.uint64)
    return _mixed(sums * _P + sizes.astype(np.uint64))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of all words as one where there are fewer."""
    n = min(n, len(hashes))
    if not n:
        return hashes
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = _mixed(out * _P + hashes[k : k + len(out)] + np.uint64(k))
    return out


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The distinct n-grams of a text, long ones first (long words are rare ones), then by hash."""
    words = lower_words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = ngram_hashes(word_hashes(words), n)
    sizes = np.cumsum([0, *map(len, words)])
    k = len(words) - len(grams) + 1
    length = np.minimum(sizes[k:] - sizes[:-k], 255).astype(np.uint64)
    # The length replaces the lowest byte, complemented, so that one sort gives the order. Equal n-grams have equal lengths.
    keyed = np.unique(grams & ~np.uint64(255) | (np.uint64(255) - length))
    return keyed[np.lexsort((keyed, keyed & np.uint64(255)))]


def allowed(n: int, percent: int) -> int:
    """How many of ``n`` elements a partner at the threshold may lack."""
    return n - -(-percent * n // 100)


def _fold(tokens: np.ndarray) -> tuple[int, int]:
    a, b = _mixed(tokens), _mixed(tokens ^ np.uint64(0x5851F42D4C957F2D))
    return int(a.sum().astype(np.int64)), int(_mixed(b).sum().astype(np.int64))


def _sets(docs: DataFrame, n: int, percent: int, schema: str) -> DataFrame:
    """Hashes of every document's set, with its first elements (``PRINTS``), with all (``SETS``) or with its parity maps (``MAPS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column(2).to_pylist()]
            if not sets:
                continue
            folds = [_fold(s) for s in sets]
            sizes = [len(s) for s in sets]
            if schema == MAPS:
                lists = [links.parities(np.concatenate(sets), np.array(sizes)), links.wide_parities(sets)]
            else:
                kept = sets if schema == SETS else [s[: allowed(len(s), percent) + 2 + SPARE] for s in sets]
                stops = np.cumsum([0, *map(len, kept)])
                lists = [pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(kept).astype(np.int64), pa.int64()))]
            columns = [pa.array(sizes, pa.int32()), pa.array([f[0] for f in folds], pa.int64()), pa.array([f[1] for f in folds], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(sizes, pa.int32()), *lists], names)

    return map_arrow(docs.select("doc_id", "row", "text"), run, schema)


def boundary(costs: list[tuple[int, int, float]], percent: int) -> int:
    """The size up to which sets are small. ``costs``: per size the number of sets and the candidates of their lists."""
    best, at, small, large = None, 0, 0.0, sum(m * (allowed(n, percent) + 1) + PER_CANDIDATE * c for n, m, c in costs)
    for n, m, c in sorted(costs):
        if best is None or small + large < best:
            best, at = small + large, n - 1
        p = allowed(n, percent) + 2
        small += m * p * (p - 1) / 2
        large -= m * (allowed(n, percent) + 1) + PER_CANDIDATE * c
    if best is None or small + large < best:
        at = max((n for n, _, _ in costs), default=0)
    return at


def classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, row, n, node``, where ``node`` is one row of all documents with an equal set."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    prints = materialize(_sets(rows, n, percent, PRINTS), "set-prints")
    same = prints.groupBy("h1", "h2", "n").agg(F.min("row").alias("node"))
    out = materialize(prints.join(same, ["h1", "h2", "n"]), "set-classes")
    discard(prints)
    return out


def join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", count_links: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, class_id, linked_with, n_links``.

    Texts are lower-cased (A-Z only) and cut at white space. ``component_id`` is the smallest id reachable by links,
    itself included; ``class_id`` the smallest id with an equal set; ``linked_with`` the smallest ``class_id`` among the verified links that hold its
    component together (null without any); ``n_links`` the number of other classes that its class links with
    (no such column without ``count_links``, which spares the comparisons inside components).
    A null or empty text has the empty set, which links with nothing, not even with its like. A null id is never a smallest
    id; a group of such rows has a null component. Repeated rows link like other copies.
    """
    whole = classes(docs, n, percent, doc_id, text)
    every = materialize(whole.drop("prefix"), "set-members")
    single = whole.where((F.col("row") == F.col("node")) & (F.col("n") > 0))
    # The closest partner of a set of n elements has one more: n / (n + 1) reaches the threshold from percent / (100 - percent) on.
    # Below only equal sets do, and those are one class.
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 30
    heads = single.where(F.col("n") >= least).select("node", "doc_id", "h1", "h2", "n", "prefix")
    prefixes, at = _prefixes(docs, heads, n, percent, doc_id, text)
    discard(whole)  # prefixes are the bulk of it
    heads = every.where((F.col("row") == F.col("node")) & (F.col("n") >= least)).select("node", "doc_id", "h1", "h2", "n")
    keys = _keys(prefixes, at, percent)
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("key")
    buckets = materialize(_of_like_size(keys.join(many, "key"), percent), "bucket-rows")
    discard(prefixes)
    wanted = heads.join(buckets.select("node").distinct(), "node", "left_semi")
    maps = _whole(docs, wanted, n, percent, doc_id, text, MAPS)

    def fetch(nodes: DataFrame) -> DataFrame:
        return _whole(docs, heads.join(links.broadcast_small(nodes), "node", "left_semi"), n, percent, doc_id, text)

    edges, parts = links.link(buckets, maps, percent, fetch=fetch)
    discard(buckets)
    discard(maps)
    ids = every.groupBy("node").agg(F.min("doc_id").alias("class_id"))
    named = ids.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(lowest, "component").select("node", "class_id", "component_id")
    if count_links:
        sets = fetch(materialize(parts.select("node"), "linked-nodes"))
        named = named.join(links.degrees(edges, parts, sets, percent), "node", "left")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partner = both.join(ids.select(F.col("node").alias("b"), "class_id"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class_id").alias("linked_with"))
    named = named.join(partner, "node", "left")
    alone = F.col("n") == 0
    return every.join(named, "node").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "linked_with",
        *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []),
    )


def _whole(docs: DataFrame, wanted: DataFrame, n: int, percent: int, doc_id: str, text: str, schema: str = SETS) -> DataFrame:
    """``node, n`` with tokens or maps for the wanted heads: their documents are read again. Rows that repeat an id and a text give a set twice."""
    wanted = materialize(wanted.select("node", F.col("doc_id").alias("_id"), "h1", "h2"), "wanted-sets")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ids = materialize(wanted.select("_id").distinct(), "wanted-ids")
    near = texts.join(links.broadcast_small(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = _sets(near.withColumn("row", F.lit(0).cast("long")), n, percent, schema)
    found = sets.join(links.broadcast_small(wanted).drop("n"), ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("_id")))
    return materialize(found.select("node", "n", *sets.columns[6:]), "whole-sets")


def _prefixes(docs: DataFrame, heads: DataFrame, n: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """``node, n, few, prefix`` with frequent elements at the end of the order, and the size up to which sets are small.

    Which elements are frequent is one table, so the order is the same for all sets. Sets that run out of other elements
    are counted as a whole once more, as what they share with each other may lie behind their first elements.
    """
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 2).cast("int")
    counts = heads.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("m"))
    counts = materialize(counts.where(F.col("m") > 1), "element-counts")
    frequent = materialize(counts.where(F.col("m") > FREQUENT).select("token"), "frequent-elements")

    def late(sets: DataFrame, column: str) -> DataFrame:
        found = sets.select("node", F.explode(column).alias("token")).join(frequent, "token")
        found = found.groupBy("node").agg(F.collect_list("token").alias("late"))
        return sets.join(found, "node", "left").withColumn("late", F.coalesce("late", F.array().cast("array<bigint>")))

    def ordered(sets: DataFrame, column: str) -> DataFrame:
        first = F.array_except(column, "late")
        return sets.withColumn("first", first).withColumn("prefix", F.slice(F.concat("first", F.array_intersect(column, "late")), F.lit(1), length))

    def short(placed: DataFrame):
        return (F.size("first") < length) & (F.col("held") < F.col("n"))

    held = heads.withColumn("held", F.size("prefix"))
    lacking = ordered(late(held, "prefix"), "prefix").where(short(held)).select("node", "doc_id", "h1", "h2")
    lacking = materialize(lacking, "lacking-sets")
    if not lacking.isEmpty():
        more = _whole(docs, lacking, n, percent, doc_id, text).select(F.explode("tokens").alias("token")).groupBy("token")
        more = more.agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > FREQUENT).select("token")
        frequent = materialize(frequent.unionByName(more).distinct(), "frequent-elements")
    placed = materialize(ordered(late(held, "prefix"), "prefix").withColumn("short", short(held)), "ordered-sets")
    out = placed.where("not short").select("node", "n", F.size("first").alias("few"), "prefix")
    lacking = placed.where("short").select("node", "doc_id", "h1", "h2")
    if not lacking.isEmpty():
        whole = ordered(late(_whole(docs, lacking, n, percent, doc_id, text), "tokens"), "tokens")
        out = out.unionByName(whole.select("node", "n", F.size("first").alias("few"), "prefix"))
    out = materialize(out, "prefixes")
    discard(placed)
    # The candidates of an inverted list, from the counts of first elements; one row per size of set. Sets that meet by chance
    # are compared in full, half of them each; lists of frequent elements are of near copies, a pivot per round connects them.
    met = out.select("node", "n", F.explode(F.slice("prefix", F.lit(1), F.size("prefix") - 1)).alias("token"))
    each = F.when(F.col("m") > FREQUENT, F.lit(float(links.ROUNDS))).otherwise((F.col("m") - 1) / 2)
    met = met.join(counts, "token").groupBy("n").agg(F.sum(each).alias("met"))
    bins = materialize(out.groupBy("n").agg(F.count(F.lit(1)).alias("m")).join(met, "n", "left"), "size-costs")
    at = boundary([(r.n, r.m, r.met or 0.0) for r in bins.collect()], percent)
    return out, at


def _of_like_size(buckets: DataFrame, percent: int) -> DataFrame:
    """Buckets cut into bands of size, so that sets too different in size to be similar do not meet.

    Sizes of a similar pair lie in the same band or in neighbours, and every set is in its own and the next one.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / (1e-9 - math.log(percent / 100))) if percent < 100 else F.col("n").cast("long")
    banded = buckets.withColumn("band", F.explode(F.array(band, band + 1)))
    banded = banded.select(F.xxhash64("key", "band").alias("key"), "node", "n", "few")
    many = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("key")
    return banded.join(many, "key")


def _keys(prefixes: DataFrame, at: int, percent: int) -> DataFrame:
    """``key, node, n, few``: subsets of two for the small sets, single elements for the large."""
    small = prefixes.where(F.col("n") * percent <= at * 100)
    pairs = F.flatten(
        F.transform("prefix", lambda x, i: F.transform(F.slice("prefix", i + 2, F.size("prefix")), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y))))
    )
    subsets = small.select(F.explode(F.array_distinct(pairs)).alias("key"), "node", "n", "few")
    large = prefixes.where(F.col("n") > at)
    lists = large.select(F.explode(F.slice("prefix", F.lit(1), F.size("prefix") - 1)).alias("key"), "node", "n", "few")
    return subsets.unionByName(lists)


def dedup(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns.

    Rows that share an id share their fate: they stay if one of them represents its component. Rows without an id
    stay where no linked row has one. Empty texts link with nothing and stay.
    """
    found = join(docs, n, percent, doc_id, text, count_links=False)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    name = unused(docs, "linked")
    gone = found.groupBy(F.col("doc_id").alias(name)).agg(F.max(kept).alias("kept")).where("not kept").select(name)
    gone = materialize(gone, "linked-rows")
    # Few rows go, so texts stay where they are.
    return docs.join(links.broadcast_small(gone), F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(name)), "left_anti")
