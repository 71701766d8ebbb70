"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Rows of a source are dealt into blocks by a hash of their id; only word counts per block are gathered.
2. Per source, blocks in random order are taken until the target is reached. Every round over the source is
   one copy; the block at which the target is crossed is taken up to a row, so the target is met to about a row.
3. The taken blocks are the quotas. A binary tree over the output shards splits them: the left half of a node
   takes its number of blocks, and how many of each source these are is a multivariate-hypergeometric draw,
   made source by source from univariate ones. What is left goes right, so quotas are kept exactly.
4. A shard takes the next blocks of each source's random order. Blocks of different shards are disjoint;
   rows are ordered within a shard by a hash.

All random numbers are hashes of the seed, so a rerun gives the same mix, in whatever order tasks run. Tables
of blocks and quotas have one row per block or source. Rows meet them in one join on (source, block).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.llm.common import word_count
from barwise.session import materialize

#: Weights of the sources by rank, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a part of all words, and the most that a source gives as a multiple of its own.
SHARE, MOST = 1.5, 2.0
#: Rows of a block and words of an output shard, both on average.
BLOCK_ROWS, SHARD_WORDS = 256, 50_000_000


def uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source of ``sizes`` (source, size): ``source, rows, source_size, weight, target``.

    Sources rank by code point, null last. They share ``share`` of all words by weight; no target exceeds
    ``most`` times the source's size, and what is cut off is shared again. With the sources sorted by the weight
    at which they are full, those that are cut form a prefix, so one pass of running sums finds the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("full", F.col("source_size") * float(most))
    filled = Window.partitionBy(F.lit(0)).orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), "source")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("full").over(before), F.lit(0.0))
    weighed = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(every) * float(share) - spent) / (F.sum("weight").over(every) - weighed)
    per = per.withColumn("level", level).withColumn("cut", F.col("full") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("cut"), F.col("level"))).over(every)
    per = per.withColumn("target", F.when(F.col("cut"), F.col("full")).otherwise(level * F.col("weight")))
    return per.select("source", "rows", "source_size", "weight", "target")


def _dealt(docs: DataFrame, size: Column, doc_id: str, source: str, seed: int, per_source: DataFrame | None) -> DataFrame:
    """Rows with ``__mix_source, __mix_size, __mix_block, __mix_order``; blocks need the number of rows of the source."""
    out = docs.withColumns({"__mix_source": F.col(source).cast("string"), "__mix_size": size})
    joined = out.join(
        per_source.select(F.col("source").alias("__mix_name"), F.ceil(F.col("rows") / BLOCK_ROWS).alias("__mix_blocks")),
        F.col("__mix_source").eqNullSafe(F.col("__mix_name")),
    )
    unit = F.xxhash64(F.lit(seed), F.col(doc_id).cast("long"), F.col("__mix_size"))
    return joined.withColumns(
        {"__mix_block": F.pmod(unit, F.col("__mix_blocks")), "__mix_order": F.xxhash64(F.lit(seed + 1), F.col(doc_id).cast("long"), F.col("__mix_size"))}
    ).drop("__mix_name", "__mix_blocks")


def _quotas(rows: DataFrame, per_source: DataFrame, seed: int) -> DataFrame:
    """One row per block and copy taken: ``__mix_source, __mix_block, copy, upto, unit``.

    ``upto`` is the largest row order that is taken, null for a whole block. ``unit`` numbers the taken blocks of a source.
    """
    blocks = rows.groupBy("__mix_source", "__mix_block").agg(F.sum("__mix_size").alias("words"))
    joined = blocks.join(
        per_source.select(F.col("source").alias("_s"), "source_size", "target"), F.col("__mix_source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    joined = joined.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    draw = Window.partitionBy("__mix_source").orderBy(F.xxhash64(F.lit(seed + 2), "__mix_source", "__mix_block"), "__mix_block")
    upto = F.sum("words").over(draw)
    joined = joined.withColumns({"after": upto, "position": F.row_number().over(draw).cast("long")})
    joined = joined.withColumn("need", F.col("rest") - (F.col("after") - F.col("words")))
    joined = materialize(joined, "mix-blocks")
    whole_copies = joined.where("whole > 0").select(
        "__mix_source", "__mix_block", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("copy"), F.lit(None).cast("long").alias("upto")
    )
    full = joined.where("need >= words and words > 0").select(
        "__mix_source", "__mix_block", F.col("whole").alias("copy"), F.lit(None).cast("long").alias("upto")
    )
    crossed = joined.where("need > 0 and need < words").select("__mix_source", "__mix_block", "whole", "need")
    inside = rows.join(crossed.withColumnsRenamed({"__mix_source": "_s", "__mix_block": "_b"}), F.col("__mix_source").eqNullSafe(F.col("_s")) & (F.col("__mix_block") == F.col("_b")))
    run = Window.partitionBy("__mix_source", "__mix_block").orderBy("__mix_order").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("run", F.sum("__mix_size").over(run)).withColumn("tied", F.sum("__mix_size").over(Window.partitionBy("__mix_source", "__mix_block", "__mix_order")))
    part = inside.where(F.col("run") - F.col("tied") / 2 <= F.col("need")).groupBy("__mix_source", "__mix_block").agg(
        F.first("whole").alias("copy"), F.max("__mix_order").alias("upto")
    )
    taken = whole_copies.unionByName(full).unionByName(part)
    number = Window.partitionBy("__mix_source").orderBy("copy", F.xxhash64(F.lit(seed + 3), "copy", "__mix_block"), "__mix_block")
    return taken.withColumn("unit", F.row_number().over(number).cast("long") - 1)


def _log_factorial(n: Column) -> Column:
    """Exact to 20, Stirling's series beyond."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(good: Column, every: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``every`` units are among the ``good`` ones, by inverting the distribution at ``u``.

    The range searched is 12 standard deviations around the mean; outside lies less than 1e-30.
    """
    low = F.greatest(F.lit(0).cast("long"), draws + good - every)
    high = F.least(good, draws)
    mean = draws.cast("double") * good / F.greatest(every, F.lit(1))
    wide = 12 * F.sqrt(F.greatest(mean * (1 - good / F.greatest(every, F.lit(1)).cast("double")), F.lit(0.0))) + 12
    first = F.greatest(low, F.floor(mean - wide).cast("long"))
    last = F.greatest(first, F.least(high, F.ceil(mean + wide).cast("long")))
    whole = _log_choose(every, draws)

    def step(acc: Column, k: Column) -> Column:
        p = F.exp(_log_choose(good, k) + _log_choose(every - good, draws - k) - whole)
        at = acc["at"] + p
        return F.struct(at.alias("at"), F.when((acc["at"] < u) & (k > acc["k"]), k).otherwise(acc["k"]).alias("k"))

    start = F.struct(F.lit(0.0).alias("at"), first.alias("k"))
    return F.aggregate(F.sequence(first, last), start, step, lambda acc: acc["k"])


def _split(quota: Column, draws: Column, node: Column, seed: int) -> Column:
    """Of an array of quotas by source, those that a draw of ``draws`` units takes: a multivariate-hypergeometric draw."""

    def step(acc: Column, i: Column) -> Column:
        good = F.element_at(quota, i + 1)
        k = hypergeometric(good, acc["left"], acc["draws"], uniform(seed, node, i))
        return F.struct(
            (acc["left"] - good).alias("left"), (acc["draws"] - k).alias("draws"), F.concat(acc["out"], F.array(k)).alias("out")
        )

    total = F.aggregate(quota, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(total.alias("left"), draws.alias("draws"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(quota) - 1), start, step, lambda acc: acc["out"])


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``quotas`` (name, units) to ``name, shard, first, units``: the stretch of each source's units that a shard draws.

    ``shards`` is a power of two. Shard totals differ by at most one unit per level, sums per source are kept exactly.
    """
    listed = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("name").isNull().alias("n"), "name", "units"))).alias("all"))
    nodes = listed.select(F.lit(1).cast("long").alias("node"), F.col("all.name").alias("names"), F.col("all.units").alias("quota")).where(F.size("names") > 0)
    for _ in range(int(math.log2(shards))):
        total = F.aggregate("quota", F.lit(0).cast("long"), lambda a, x: a + x)
        draws = F.floor((total + F.pmod("node", F.lit(2))) / 2)
        nodes = nodes.withColumn("taken", _split(F.col("quota"), draws, F.col("node"), seed))
        # A table per level: otherwise every level would repeat the draws of all levels above.
        nodes = materialize(nodes, "mix-nodes")
        right = F.zip_with("quota", "taken", lambda a, b: a - b)
        child = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("taken").alias("quota")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quota")),
        )
        nodes = nodes.select("names", F.explode(child).alias("c")).select("c.node", "names", "c.quota")
    flat = nodes.select((F.col("node") - shards).alias("shard"), F.posexplode(F.arrays_zip("names", "quota")).alias("i", "q"))
    flat = flat.select("shard", F.col("q.names").alias("name"), F.col("q.quota").alias("units"))
    up = Window.partitionBy("name").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("first", F.coalesce(F.sum("units").over(up), F.lit(0)))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    shards: int | None = None,
    seed: int = 20,
    counted: DataFrame | None = None,
) -> DataFrame:
    """The rows of the mix: ``docs`` with ``mix_copy, mix_shard, mix_order, mix_size``; rows taken twice occur twice.

    ``size`` is the words of a row, counted from ``text`` by default. ``shards`` (a power of two) defaults to one
    per 50 million words. Write the result partitioned by ``mix_shard`` and sorted by ``mix_order``. A null source is a
    source of its own, ranked last; a source without words gives nothing; an empty table gives an empty mix.
    Rows with a null id fall into one block of their source, as do rows repeated with the same id and size, which
    are taken together. ``counted`` may give the table of ids, sources and sizes if it is at hand.
    """
    size = word_count(F.col("text")) if size is None else size
    if counted is None:
        counted = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size")), "mix-sizes")
    per_source = materialize(targets(counted.select("source", "size"), weights, share, most), "mix-targets")
    small = materialize(
        _dealt(counted.select("doc_id", "source", "size"), F.col("size"), "doc_id", "source", seed, per_source).select("__mix_source", "__mix_size", "__mix_block", "__mix_order"), "mix-rows"
    )
    taken = materialize(_quotas(small, per_source, seed), "mix-quotas")
    if shards is None:
        words = per_source.agg(F.sum("target")).first()[0] or 0.0
        shards = 2 ** max(0, math.ceil(math.log2(max(words, 1.0) / SHARD_WORDS)))
    drawn = split_quotas(taken.groupBy(F.col("__mix_source").alias("name")).agg(F.count(F.lit(1)).alias("units")), shards, seed + 4)
    cuts = drawn.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("shard", "first", "units"))).alias("cuts"))
    placed = taken.join(cuts, F.col("__mix_source").eqNullSafe(F.col("name"))).withColumn(
        "shard",
        F.filter("cuts", lambda c: (c["first"] <= F.col("unit")) & (F.col("unit") < c["first"] + c["units"]))[0]["shard"],
    )
    per_block = placed.groupBy(F.col("__mix_source").alias("__mix_of"), F.col("__mix_block").alias("__mix_at")).agg(
        F.collect_list(F.struct("copy", "upto", "shard")).alias("__mix_draws")  # at most one per copy
    )
    per_block = materialize(per_block, "mix-draws")
    dealt = _dealt(docs, size, doc_id, source, seed, per_source)
    rows = dealt.join(per_block, F.col("__mix_source").eqNullSafe(F.col("__mix_of")) & (F.col("__mix_block") == F.col("__mix_at")))
    rows = rows.withColumn("__mix_draw", F.explode("__mix_draws")).where(F.col("__mix_draw.upto").isNull() | (F.col("__mix_order") <= F.col("__mix_draw.upto")))
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("mix_copy", "mix_shard", "mix_order", "mix_size")]
    return rows.select(
        *names,
        F.col("__mix_draw.copy").alias("mix_copy"),
        F.col("__mix_draw.shard").alias("mix_shard"),
        F.xxhash64(F.lit(seed + 5), F.col(doc_id).cast("long"), "__mix_draw.copy", "__mix_draw.shard").alias("mix_order"),
        F.col("__mix_size").alias("mix_size"),
    )


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix with each shard's rows together and in random order, ready to be written by shard."""
    spread = mixed.hint("rebalance", "mix_shard")
    return spread.sortWithinPartitions("mix_shard", "mix_order")
