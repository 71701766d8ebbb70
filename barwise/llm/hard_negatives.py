"""Hard negatives by integer inner products, filtered by rotated one-bit codes.

1. Vectors become integers, are rotated (signs and Walsh-Hadamard rounds, the same in every task) and coded: one bit per
   rotated dimension and the inner product of code and vector, then the same for what the code leaves, ``LEVELS`` times. Stored
   beside the codes: length of the last residual and of the coded part. All rows are coded, once, as a table.
2. An anchor is rounded to ``PLANES`` bits a dimension, so its inner product with a code is a sum of popcounts. Cauchy-Schwarz
   bounds what the codes and the rounding leave out, so every estimate has an interval that holds the true score.
3. Only pairs whose interval reaches into the wanted range, and to the score that is last so far, are scored in integers.
   So the filter never costs a result.

Anchors are sent to the tasks in blocks of a fixed number of bytes; a block meets every row, in batches. A task
returns its best rows of every anchor, and these are ranked once more. A first pass over a part of the rows, chosen by
hash, gives every anchor a score that its last row reaches at least, so later tasks return little.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.llm.common import map_arrow
from barwise.session import materialize

LEVELS, PLANES, ROUNDS = 3, 6, 3
#: Bytes of the vectors in a block of anchors.
BLOCK_BYTES = 16 << 20
#: One row of so many is in the first pass.
SEED_PART = 32
#: Rows and anchors that are compared at a time; a task starts with fewer rows, as it has no scores to filter by.
FIRST_ROWS, MOST_ROWS, SOME_ANCHORS = 128, 2048, 256
#: Pairs that are scored at a time.
SCORED = 1 << 16
CODED = "row long, id long, label long, anchor boolean, dim int, values binary, codes binary, aligned binary, rest double, coded double"
_LOW, _HIGH = np.int64(-(1 << 62)), np.int64(1 << 62)
#: Part of a product of lengths that floating-point errors may reach.
_SLACK = 1e-9


def width(dim: int) -> int:
    """Rotated dimensions: the next power of two, 64 at least."""
    return max(64, 1 << max(0, dim - 1).bit_length())


def rotated(values: np.ndarray) -> np.ndarray:
    """Rows of ``values`` under a fixed orthogonal map."""
    n, dim = values.shape
    wide = width(dim)
    out = np.zeros((n, wide))
    out[:, :dim] = values
    signs = np.random.default_rng(wide).integers(0, 2, (ROUNDS, wide)) * 2.0 - 1.0
    for turn in signs:
        out *= turn
        step = 1
        while step < wide:
            pairs = out.reshape(n, -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, wide)
            step *= 2
        out /= np.sqrt(wide)
    return out


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, levels, words), inner products of unit code and vector (rows, levels), lengths of residual and of coded part."""
    turned = rotated(values.astype(np.float64))
    rest, codes, aligned = turned.copy(), [], []
    unit = 1 / np.sqrt(turned.shape[1])
    for _ in range(LEVELS):
        up = rest >= 0
        along = np.abs(rest).sum(axis=1) * unit
        rest -= np.where(up, unit, -unit) * along[:, None]
        codes.append(_words(up))
        aligned.append(along)
    return np.stack(codes, axis=1), np.stack(aligned, axis=1), np.linalg.norm(rest, axis=1), np.linalg.norm(turned - rest, axis=1)


class Queries:
    """Anchors of one dimension, rounded to bit planes."""

    def __init__(self, values: np.ndarray):
        turned = rotated(values.astype(np.float64))
        self.wide = turned.shape[1]
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        levels = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, (1 << PLANES) - 1).astype(np.int64)
        self.planes = np.stack([_words((levels >> b) & 1 == 1) for b in range(PLANES)])
        self.total = levels.sum(axis=1)
        self.missed = np.linalg.norm(turned - (self.low[:, None] + self.step[:, None] * levels), axis=1)
        self.length = np.linalg.norm(turned, axis=1)

    def intervals(self, some: slice, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible inner products of the anchors ``some`` with the coded rows."""
        low, step, total = self.low[some, None], self.step[some, None], self.total[some, None]
        middle = np.zeros((len(low), len(codes)))
        for level in range(codes.shape[1]):
            meet = np.zeros(middle.shape, dtype=np.int32)
            ones = np.bitwise_count(codes[:, level]).sum(axis=1, dtype=np.int64)
            for word in range(codes.shape[2]):
                column = codes[:, level, word][None, :]
                for plane in range(PLANES):
                    meet += np.bitwise_count(self.planes[plane, some, word][:, None] & column).astype(np.int32) << plane
            along = low * (2 * ones[None, :] - self.wide) + step * (2.0 * meet - total)
            middle += along * (aligned[:, level] / np.sqrt(self.wide))[None, :]
        length = self.length[some, None]
        margin = coded[None, :] * self.missed[some, None] + rest[None, :] * length
        margin += _SLACK * (1 + length) * (1 + coded + rest)[None, :]
        return middle - margin, middle + margin


def _largest(dim: int) -> int:
    """Components below this in absolute value have inner products that a long holds."""
    return int(np.sqrt((1 << 62) / max(1, dim)))


def coded(rows: DataFrame, is_anchor: Column, vec_id: str, vector: str, label: str, scale: float) -> DataFrame:
    """All rows that take part, with integers and codes, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CODED.split(", ")]
        for batch in batches:
            lists = batch.column(4).combine_chunks() if isinstance(batch.column(4), pa.ChunkedArray) else batch.column(4)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            sizes = np.diff(ends, prepend=0)
            flat = lists.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(scale * flat.astype(np.float64))
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                if not dim:
                    continue
                values = flat[(ends[at] - dim)[:, None] + np.arange(dim)[None, :]]
                fine = np.isfinite(values).all(axis=1) & (np.abs(values) < _largest(dim)).all(axis=1)
                at, values = at[fine], values[fine]
                if not len(at):
                    continue
                codes, aligned, rest, kept = encode(values)
                taken = batch.select([0, 1, 2, 3]).take(pa.array(at))
                binary = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (values.astype("<i8"), codes, aligned.astype("<f8"))]
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(np.full(len(at), dim), pa.int32()), *binary, pa.array(rest), pa.array(kept)], names
                )

    table = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vector"),
    ).where(F.col("label").isNotNull() & F.col("vector").isNotNull())
    return materialize(map_arrow(table, run, CODED), "coded-vectors")


class _Block:
    """Rows of one dimension, unpacked."""

    def __init__(self, batch: pa.Table, at: np.ndarray, dim: int):
        def column(name: str, kind: str, *shape: int) -> np.ndarray:
            return np.frombuffer(b"".join(part.column(name).to_pylist()), kind).reshape(len(at), *shape)

        part = batch.take(pa.array(at))
        self.row = part.column("row").to_numpy()
        ids = part.column("id")
        self.known = ids.is_valid().to_numpy()
        self.id = ids.fill_null(0).to_numpy()
        self.label = part.column("label").to_numpy()
        self.values = column("values", "<i8", dim)
        self.codes, self.aligned = column("codes", "<u8", LEVELS, -1), column("aligned", "<f8", LEVELS)
        self.rest, self.coded = part.column("rest").to_numpy(), part.column("coded").to_numpy()


def by_dim(batch: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def first(group: np.ndarray, score: np.ndarray, known: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of every group: by score, then id (missing last), then row."""
    order = np.lexsort((row, ids, ~known, -score, group))
    place = group[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    rank = np.arange(len(place)) - np.repeat(starts, np.diff(np.append(starts, len(place))))
    return order[rank < k]


class Best:
    """The first ``k`` rows so far of every slot; a slot is an anchor, or an anchor with a range of scores."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.held = tuple(np.zeros(0, x) for x in (np.int64, np.int64, bool, np.int64, np.int64))

    def add(self, *found: np.ndarray) -> None:
        """``found``: slot, score, known, id, row."""
        held = [np.concatenate(x) for x in zip(self.held, found, strict=True)]
        keep = first(*held, self.k)
        self.held = tuple(x[keep] for x in held)
        slot, score = self.held[:2]
        if len(slot):
            full = np.flatnonzero(np.bincount(slot, minlength=len(self.floor)) >= self.k)
            last = np.full(len(self.floor), _HIGH)
            np.minimum.at(last, slot, score)
            self.floor[full] = np.maximum(self.floor[full], last[full])


class Anchors:
    """A block of anchors with the slots that are to be filled for them.

    ``same``: rows must have the anchor's label (and be other rows), else another label. Slot ``j`` of anchor ``i`` takes scores
    from ``low[i, j]`` to ``high[i, j]``, and needs at least ``floor[i, j]``.
    """

    def __init__(self, table: pa.Table, low: np.ndarray, high: np.ndarray, floor: np.ndarray, same: bool, k: int):
        self.table, self.low, self.high, self.floor, self.same, self.k = table, low, high, floor, same, k

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = self.low.shape[1]
        best = Best(np.maximum(self.floor, self.low).reshape(-1), self.k)
        groups = {dim: (at, _Block(self.table, at, dim)) for dim, at in by_dim(self.table)}
        queries = {dim: Queries(block.values) for dim, (_, block) in groups.items()}
        size = FIRST_ROWS
        for batch in batches:
            table, at = pa.Table.from_batches([batch]), 0
            while at < len(table):
                part = table.slice(at, size)
                at, size = at + size, min(2 * size, MOST_ROWS)
                for dim, rows in by_dim(part):
                    if dim in groups:
                        self._meet(best, *groups[dim], queries[dim], _Block(part, rows, dim), slots)
        slot, score, known, ids, row = best.held
        if len(slot):
            own = self.table.column("row").to_numpy()[slot // slots]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array((slot % slots).astype(np.int32)), pa.array(score), pa.array(ids, mask=~known), pa.array(row)],
                ["anchor", "slot", "score", "id", "row"],
            )

    def _meet(self, best: Best, at: np.ndarray, anchors: _Block, queries: Queries, rows: _Block, slots: int) -> None:
        for start in range(0, len(at), SOME_ANCHORS):
            some = slice(start, start + SOME_ANCHORS)
            place = at[some]
            floor, high = best.floor.reshape(-1, slots)[place], self.high[place]
            alike = anchors.label[some, None] == rows.label[None, :]
            wanted = alike & (anchors.row[some, None] != rows.row[None, :]) if self.same else ~alike
            least, most = queries.intervals(some, rows.codes, rows.aligned, rows.rest, rows.coded)
            # The lowest of the floors and the highest of the ranges stand for all slots of an anchor.
            wanted &= (most >= floor.min(axis=1)[:, None]) & (least <= high.max(axis=1)[:, None])
            a, r = np.nonzero(wanted)
            for low in range(0, len(a), SCORED):
                x, y = a[low : low + SCORED], r[low : low + SCORED]
                score = np.einsum("ij,ij->i", anchors.values[some][x], rows.values[y])
                inside = (score[:, None] >= floor[x]) & (score[:, None] <= high[x])
                pair, slot = np.nonzero(inside)
                y = y[pair]
                best.add(place[x[pair]] * slots + slot, score[pair], rows.known[y], rows.id[y], rows.row[y])


FOUND = "anchor long, slot int, score long, id long, row long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(rows: DataFrame, block: Callable[[np.ndarray], Anchors], shape: tuple[int, int], k: int, own: pa.Table) -> DataFrame:
    """The first ``k`` rows of every slot among ``rows``, ranked."""
    seeds = map_arrow(rows.where(F.pmod(F.xxhash64("row"), F.lit(SEED_PART)) == 0), block(np.full(shape, _LOW)).run, FOUND)
    last = _ranked(seeds, k).where(F.col("rank") == k).select("anchor", "slot", "score").toArrow()
    place = {row: i for i, row in enumerate(own.column("row").to_pylist())}
    floor = np.full(shape, _LOW)
    for anchor, slot, score in zip(*(c.to_pylist() for c in last.columns), strict=True):
        floor[place[anchor], slot] = score
    return _ranked(map_arrow(rows, block(floor).run, FOUND), k)


def mine(
    rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    n_positives: int = 5, n_negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: float = 1.0,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: the hardest negatives per anchor and positive.

    Components become ``floor(scale * x)``; scores are integer inner products; ties go to the smaller id. The positives of an anchor are
    its ``n_positives`` best other rows of its label, the negatives the best ``n_negatives`` rows of other labels with
    low_percent * positive <= 100 * negative <= high_percent * positive.

    Rows without a label or vector, with an empty vector, or with a null or non-finite component take no part, nor do rows with
    components so large that a long cannot hold their scores. Vectors of unlike length do not meet. A row without an id can be found
    (after all ids of its score) but is an anchor only if ``is_anchor`` says so. Repeated rows are rows of their own, so a repeated
    anchor is answered twice. Without rows or anchors the result is empty.
    """
    spark = rows.sparkSession
    if isinstance(label, Column):
        name = next(f"label{i}" for i in range(len(rows.columns) + 1) if f"label{i}" not in rows.columns)
        rows, label = rows.withColumn(name, label), name
    table = coded(rows, is_anchor, vec_id, vector, label, scale)
    size, widest = table.where("anchor").agg(F.count(F.lit(1)), F.max("dim")).first()
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = max(1, -(-size * 8 * (widest or 1) // block_bytes))
    for number in range(blocks if size else 0):
        # A block is bounded by ``block_bytes`` (evenly dealt by hash of the row), so the driver may hold it.
        own = table.where(F.col("anchor") & (F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)) == number)).toArrow()
        out = out.unionByName(_mined(table, own, n_positives, n_negatives, low_percent, high_percent))
    return out


def _mined(table: DataFrame, own: pa.Table, n_positives: int, n_negatives: int, low_percent: int, high_percent: int) -> DataFrame:
    spark, n = table.sparkSession, own.num_rows
    any_score = np.full((n, 1), _LOW), np.full((n, 1), _HIGH)
    held = spark.sparkContext.broadcast(own)

    def block(low: np.ndarray, high: np.ndarray, same: bool, k: int) -> Callable[[np.ndarray], "_Sent"]:
        return lambda floor: _Sent(held, low, high, floor, same, k)

    positives = _best(table, block(*any_score, True, n_positives), (n, 1), n_positives, own)
    positives = materialize(positives.select("anchor", "rank", "id", "score"), "positives")
    # At most ``n_positives`` rows per anchor of the block.
    place = {row: i for i, row in enumerate(own.column("row").to_pylist())}
    low, high = np.full((n, n_positives), _HIGH), np.full((n, n_positives), _LOW)
    for anchor, rank, _, score in zip(*(c.to_pylist() for c in positives.toArrow().columns), strict=True):
        low[place[anchor], rank - 1] = -(-low_percent * score // 100)
        high[place[anchor], rank - 1] = high_percent * score // 100
    negatives = _best(table, block(low, high, False, n_negatives), (n, n_positives), n_negatives, own)
    negatives = materialize(negatives.select("anchor", (F.col("slot") + 1).alias("place"), "rank", "id", "score"), "negatives")
    ids = table.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = positives.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = negatives.join(pairs, ["anchor", "place"]).join(ids, "anchor")
    return joined.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


class _Sent:
    """``Anchors`` around a block that travels as a broadcast."""

    def __init__(self, held, low: np.ndarray, high: np.ndarray, floor: np.ndarray, same: bool, k: int):
        self.held, self.rest = held, (low, high, floor, same, k)

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return Anchors(self.held.value, *self.rest).run(batches)
