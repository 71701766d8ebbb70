"""Similar pairs and their components from buckets of candidates, without all pairs of a bucket.

Nodes are distinct sets (copies are merged before), a bucket holds the nodes that share a key, and every similar
pair shares some bucket. What matters is which nodes end up connected. So each round compares the members of a
bucket with one pivot only and leaves buckets alone whose members are already connected; a group of thousands
of near copies is connected by about one comparison per member. What the rounds leave open is compared in full:
pairs of one bucket in different components, so no link between components is lost. Every row of a bucket carries the size and a
parity map of its set, which reject pairs that are no link exactly, before a pair is made. A short map says little about a large set, so the pairs
made can be tried on maps as long as the sets are large (``wide``); sets are read and moved only for what is left.

How many similar partners a node has is counted afterwards (``degrees``). All of them lie in its component, so the
members of a component are compared all with all, in chunks; only counts per node and chunk leave a task.

Tables between rounds are written to the shared folder. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.session import discard, materialize

#: Rounds against one pivot before the open pairs are compared in full.
ROUNDS = 4
#: Nodes and elements of a chunk of a component, on average; two chunks are compared in one task.
CHUNK_NODES, CHUNK_TOKENS = 256, 1_000_000
#: Elements that a comparison of chunks holds as columns of a matrix at a time.
CHUNK_COLUMNS = 4096
#: Rows of a few numbers each that may be sent to every task: 40 bytes a row, so 20 MB.
BROADCAST_ROWS = 500_000


def broadcast_small(table: DataFrame) -> DataFrame:
    """A written table of ids and hashes, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows. Larger ones are left
    to the planner, which joins them by shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` to ``node, component`` (the smallest node reachable), for nodes with an edge.

    Alternating large and small stars: every step replaces edges by edges to the smallest neighbour, until
    nothing changes. A hub's edges meet only in a minimum, which combines before the shuffle.
    """
    current = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = materialize(current, "star-edges")
    state = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()
        old, current = current, materialize(small, "star-edges")
        discard(old)
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


#: Longs of a parity map.
PARITY = 4


def parities(tokens: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Parity maps of sets of hashes, given end to end with their sizes: a bit, chosen by the hash, is turned once per element.

    Two maps differ in at most as many bits as the sets differ in elements, so they bound what the sets share.
    """
    wide = 64 * PARITY
    place = np.repeat(np.arange(len(counts)), counts) * wide + (tokens.astype(np.uint64) >> np.uint64(8) & np.uint64(wide - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=len(counts) * wide).reshape(-1, wide) & 1
    maps = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8")
    return pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * PARITY, pa.array(maps.reshape(-1)))


def wide_parities(sets: list[np.ndarray]) -> pa.ListArray:
    """Parity maps with a bit per element or up to twice that, of 2**k longs. Half a map, turned by the other half, is the map of half the length."""
    maps = []
    for tokens in sets:
        longs = max(PARITY, 1 << (max(len(tokens), 1) - 1 >> 6).bit_length())
        place = (tokens.astype(np.uint64) >> np.uint64(8) & np.uint64(64 * longs - 1)).astype(np.int64)
        maps.append(np.packbits((np.bincount(place, minlength=64 * longs) & 1).astype(np.uint8), bitorder="little").view("<i8"))
    stops = np.cumsum([0, *map(len, maps)]).astype(np.int32)
    return pa.ListArray.from_arrays(stops, pa.array(np.concatenate(maps) if maps else np.zeros(0, np.int64)))


def may_link(percent: int) -> Column:
    """Whether sets of sizes ``n``, ``n2`` with ``parity``, ``parity2`` can reach the threshold: they share at most half of what remains of
    both sizes without the differing bits."""
    bits = sum(F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("parity2", F.lit(i)))) for i in range(PARITY))
    total = F.col("n") + F.col("n2")
    return (100 + percent) * (total - bits) >= 2 * percent * total


def near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that can be links by their wide maps. ``sets``: node, n, wide. Maps of lengths further apart than twice reject nothing."""
    met = pairs.join(sets.select(F.col("node").alias("a"), "n", "wide"), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("wide").alias("wide2")), "b")

    def halved(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))

    def differing(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, k: s + k)

    x, y = F.col("wide"), F.col("wide2")
    bits = F.when(F.size(x) == F.size(y), differing(x, y)).when(F.size(x) == 2 * F.size(y), differing(halved(x), y))
    bits = bits.when(2 * F.size(x) == F.size(y), differing(x, halved(y))).otherwise(0)
    total = F.col("n") + F.col("n2")
    return met.where((100 + percent) * (total - bits) >= 2 * percent * total).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have 100 * intersection >= percent * union. ``sets``: node, tokens."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    met = pairs.join(left, "a").join(right, "b")
    met = met.withColumn("both", F.size(F.array_intersect("ta", "tb")))
    # A set may stand in the table twice, for rows that repeat an id and a text.
    return met.where(100 * F.col("both") >= percent * (F.size("ta") + F.size("tb") - F.col("both"))).select("a", "b").distinct()


def link(
    buckets: DataFrame, sets: DataFrame, percent: int, rounds: int = ROUNDS, fetch: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``buckets`` (key, node, n: size of the set, few: smaller is a better pivot) to (edges, components). ``sets``: node, tokens, parity.

    With ``fetch`` the sets have ``n, wide`` (see ``wide_parities``) in place of their tokens; it is given a written table of nodes and returns
    ``node, tokens`` of these as a written table, which is deleted after the round.

    Give the buckets as a written table without those of one node; every round reads it.

    The edges connect exactly what all similar pairs of the buckets connect; they are not all such pairs.
    """
    maps = sets.select("node", "parity").dropDuplicates(["node"])
    keys = materialize(buckets.join(maps, "node"), "bucket-maps")
    wide = sets.select("node", "n", "wide").dropDuplicates(["node"]) if fetch else None
    spark = buckets.sparkSession
    edges = spark.createDataFrame([], "a long, b long")
    parts = spark.createDataFrame([], "node long, component long")
    tried = edges
    turn = 0
    while True:
        now = keys.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        order = F.struct("few", "node") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "node"), F.col("node"))
        open_ = now.groupBy("key").agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.min_by(F.struct("node", "n", "component", "parity"), order).alias("p"),
        ).where(F.col("low") < F.col("high"))
        if turn < rounds:
            met = now.join(open_.select("key", "p"), "key").select(
                "node", "n", "component", "parity", F.col("p.node").alias("node2"), F.col("p.n").alias("n2"), F.col("p.component").alias("component2"),
                F.col("p.parity").alias("parity2"),
            )
        else:
            rest = now.join(open_.select("key"), "key", "left_semi")
            other = rest.select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "component", "parity")])
            met = rest.join(other, "key").where(F.col("node") < F.col("node2"))
        # What cannot be a link by size or parity map is no pair at all, so few pairs are made however many meet.
        met = met.where(F.col("component") != F.col("component2"))
        met = met.where(100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")).where(may_link(percent))
        pairs = met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "candidate-pairs")
        if fetch:
            close = materialize(near(pairs, wide, percent), "close-pairs")
            nodes = materialize(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "close-nodes")
            # Sets are read only where a pair is left.
            held = None if nodes.isEmpty() else fetch(nodes)
            found = materialize(verified(close, held, percent), "linked-pairs") if held else close
            discard(held)
        else:
            found = materialize(verified(pairs, sets, percent), "linked-pairs")
        some = not found.isEmpty()
        if some:
            edges = edges.unionByName(found)
            before, parts = parts, materialize(components(edges), "components")
            discard(before)
        if turn == rounds:
            discard(keys)
            return edges, parts
        tried = tried.unionByName(pairs)
        turn = turn + 1 if some else rounds


def _shared(rows: np.ndarray, tokens: np.ndarray, size: int) -> np.ndarray:
    """Shared elements of all pairs of ``size`` sets, given as (set, element) without repeats: a product of 0/1 matrices.

    Counts stay below 2**24, so they are exact in 32 bits. An element of one set only is in no pair.
    """
    both = np.zeros((size, size), dtype=np.float32)
    order = np.argsort(tokens, kind="stable")
    rows, tokens = rows[order], tokens[order]
    column = np.cumsum(np.concatenate([[True], tokens[1:] != tokens[:-1]])) - 1
    many = np.bincount(column)[column] > 1
    rows, column = rows[many], column[many]
    column = np.unique(column, return_inverse=True)[1].reshape(-1)
    edges = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + 1 + CHUNK_COLUMNS, CHUNK_COLUMNS))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if low < high:
            part = np.zeros((size, CHUNK_COLUMNS), dtype=np.float32)
            part[rows[low:high], column[low:high] - column[low]] = 1
            both += part @ part.T
    return both


def degrees(edges: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, n_links``: with how many nodes every node of ``parts`` is similar. ``edges`` and ``parts`` as from ``link``, ``sets``: node, n, tokens.

    A component whose edges are all its pairs is counted from these. Members of the others are dealt into chunks by hash, and
    every two chunks of a component meet in one task. The comparisons grow with the square of a component, the rows
    with that square divided by the chunk.
    """
    edges = materialize(edges, "links")
    held = edges.join(parts.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("held"))
    # A set may stand in the table twice, for rows that repeat an id and a text.
    sizes = sets.select("node", "n").distinct().join(parts, "node").groupBy("component")
    sizes = sizes.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all")).join(held, "component")
    sizes = materialize(sizes.withColumn("open", 2 * F.col("held") < F.col("k") * (F.col("k") - 1)), "component-sizes")
    closed = parts.join(sizes.where("not open"), "component").select("node", (F.col("k") - 1).alias("n_links"))
    chunks = F.ceil(F.greatest(F.col("k") / CHUNK_NODES, F.col("all") / CHUNK_TOKENS)).cast("int")
    wanted = parts.join(sizes.where("open").select("component", chunks.alias("chunks")), "component")
    dealt = sets.select("node", "tokens").join(wanted, "node").dropDuplicates(["node"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "tokens")

    def count(table: pa.Table) -> pa.Table:
        node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
        lists = table.column("tokens").combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        both = _shared(np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(), len(n)).astype(np.int64)
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        np.fill_diagonal(linked, False)
        # Two chunks meet for the pairs across them; pairs inside a chunk are counted where it meets itself.
        if table.column("low")[0].as_py() != table.column("high")[0].as_py():
            linked &= own[:, None] != own[None, :]
        return pa.table({"node": pa.array(node, pa.int64()), "n_links": pa.array(linked.sum(axis=1), pa.int64())})

    met = dealt.groupBy("component", "low", "high").applyInArrow(count, "node long, n_links long")
    return closed.unionByName(met.groupBy("node").agg(F.sum("n_links").alias("n_links")))
