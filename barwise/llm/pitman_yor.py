"""Language-model scoring with a hierarchical Pitman-Yor model.

* Word contexts: a restaurant per word that occurs, whatever its count; customers are the words that follow it, as often as they do. Its
  base measure is that of the classes: the class of the next word after the class of the word before, then the word within its class.
* Class contexts: a restaurant per class of the previous token; customers are the tables of the word contexts, by class. All share
  the root restaurant over classes as parent, which has a customer for each of their tables; its parent is uniform.
* Word restaurants: one per class of rare words; customers are the tables of the word contexts, by word. Their base measure gives half to one
  outcome for all words never seen and half evenly to the class's words.

Classes are what the word contexts fall back to. A frequent word is its own class, other words share classes by their last three bytes
(those with enough tokens, the rest in one). Frequent means a part ``SHARE`` of all tokens, so there are at most 2 / SHARE + 2 classes
however large the corpus is; words that follow each other are counted and predicted as words.

Seatings are sampled by Gibbs sweeps. A sweep unseats all customers of a dish in a restaurant and seats them one after the
other given the tables of all other dishes and the parent; dishes of one sweep see the tables of the sweep before, so they are
sampled in parallel over the rows of the count tables. A dish with one customer has one table. Beyond ``EXACT`` customers the way to the next
new table is drawn from the continuous form of its distribution. Levels are swept in turn: classes with a table per dish of the word contexts,
the word contexts given these, then classes again from the tables of the word contexts. Predictive probabilities are averaged over the kept sweeps.

Counts of all words and of all words that follow each other stay tables. A bounded number of the most frequent ones goes to the tasks as arrays; the
others of the documents are joined by shuffle, with their counts per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import folds, lower_words_of, map_arrow
from barwise.llm.language_id import SortedHashes
from barwise.llm.set_join import _mixed, word_hashes
from barwise.session import CLEAN_UP, discard, materialize, setting

#: Part of all tokens from which a word, or an ending, is a class of its own.
SHARE = 2e-4
#: Most words whose counts every task holds: 24 bytes each.
LOOKUP = 250_000
#: The same for words that follow each other; 16 bytes each. Rows of word contexts that a task seats at a time.
PAIR_LOOKUP, SEATED = 1_000_000, 200_000
#: Sweeps that are dropped and kept; customers seated one by one; strength of all restaurants.
BURN, KEEP, EXACT, THETA = 3, 3, 64, 1.0
UNSEEN = 0.5
#: Tokens gathered before a task counts them.
GATHER = 4_000_000
END = np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and endings of all tokens, one end token after every text, and where each text begins."""
    words = [lower_words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = [w for ws in words for w in ws]
    lengths = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    data = np.frombuffer(b"".join(flat), dtype=np.uint8).astype(np.int64)
    last = np.cumsum(lengths) - 1
    ending = np.zeros(len(flat), dtype=np.int64)
    for k in range(3):
        ending = ending * 256 + np.where(lengths > k, data[np.maximum(last - k, 0)] if len(data) else 0, 0)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(words)), sizes)
    out, ends = np.full(len(flat) + len(words), END, dtype=np.uint64), np.zeros(len(flat) + len(words), dtype=np.int64)
    out[at], ends[at] = word_hashes(flat), ending
    return out, ends, np.cumsum(sizes + 1) - sizes - 1


@dataclass
class Classes:
    """Class 0 holds what has no other; frequent words come next, endings last."""

    frequent: np.ndarray
    endings: np.ndarray

    def __post_init__(self):
        self.words = SortedHashes(self.frequent)

    @property
    def size(self) -> int:
        return 1 + len(self.frequent) + len(self.endings)

    @property
    def end(self) -> int:
        return int(self.words.find(np.array([END]))[0]) + 1

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        word = self.words.find(hashes)
        if not len(self.endings):
            return word + 1
        place = np.minimum(np.searchsorted(self.endings, endings), len(self.endings) - 1)
        rare = np.where(self.endings[place] == endings, place + 1 + len(self.frequent), 0)
        return np.where(word >= 0, word + 1, rare)


def _uniform(keys: np.ndarray, step: int) -> np.ndarray:
    x = _mixed(keys + np.uint64(step * int(_P) & ((1 << 64) - 1)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def seat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, keys: np.ndarray, theta: float = THETA) -> np.ndarray:
    """Tables after seating ``customers`` of each dish. ``others``: tables of the restaurant's other dishes;
    ``parent``: the dish's probability in the parent; ``keys`` seed the dishes."""
    order = np.argsort(-customers, kind="stable")
    c, rest, up, seeds = customers[order].astype(np.float64), others[order], parent[order], keys[order]
    t = (c > 0).astype(np.float64)
    live = int((c > 1).sum())
    for i in range(1, EXACT):
        if not live:
            break
        new = (theta + discount * (rest[:live] + t[:live])) * up[:live]
        t[:live] += _uniform(seeds[:live], i) * (new + i - discount * t[:live]) < new
        live = int((c[:live] > i + 1).sum())
    at = np.full(live, float(EXACT))
    on, step = np.arange(live), EXACT
    while len(on):
        step += 1
        new = np.maximum((theta + discount * (rest[on] + t[on])) * up[on], 1e-300)
        taken = discount * t[on]
        with np.errstate(over="ignore"):
            ahead = taken + (at[on] - taken) * _uniform(seeds[on], step) ** (-1.0 / new)
        more = ahead < c[on]
        on = on[more]
        at[on] = np.floor(ahead[more]) + 1
        t[on] += 1
        on = on[at[on] < c[on]]
    out = np.empty(len(t))
    out[order] = t
    return out


def _discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


def _learns(doc_id: str):
    return F.coalesce(folds(F.col(doc_id)), F.lit(-1)) != 1


def _counts(docs: DataFrame) -> DataFrame:
    """``hash, ending, c`` of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted():
            hashes, first, c = np.unique(np.concatenate([g[0] for g in gathered]), return_index=True, return_counts=True)
            ends = np.concatenate([g[1] for g in gathered])[first]
            for low in range(0, len(hashes), 100_000):
                part = slice(low, low + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[part].astype(np.int64)), pa.array(ends[part]), pa.array(c[part].astype(np.int64))], ["hash", "ending", "c"])

        gathered, n = [], 0
        for batch in batches:
            gathered.append(tokens(batch.column(0).to_pylist())[:2])
            n += len(gathered[-1][0])
            if n >= GATHER:
                yield from counted()
                gathered, n = [], 0
        if n:
            yield from counted()

    return map_arrow(docs.select("text"), run, "hash long, ending long, c long").groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(u) + w)


def _before(now: np.ndarray, starts: np.ndarray, end) -> np.ndarray:
    """The token before each token; texts begin after an end."""
    before = np.concatenate([now[-1:], now[:-1]])
    before[starts] = end
    return before


def _follows(docs: DataFrame, classes: Classes) -> DataFrame:
    """``u, w, code, c``: how often word w follows word u; ``code`` is the class of u times the number of classes plus that of w."""
    size, end = classes.size, classes.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted():
            u, w, code = (np.concatenate([g[i] for g in gathered]) for i in range(3))
            _, first, c = np.unique(_pair(u, w), return_index=True, return_counts=True)
            order = np.argsort(u[first])
            first, c = first[order], c[order]
            for low in range(0, len(first), 100_000):
                at = first[low : low + 100_000]
                columns = [u[at].astype(np.int64), w[at].astype(np.int64), code[at], c[low : low + 100_000].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["u", "w", "code", "c"])

        gathered, n = [], 0
        for batch in batches:
            hashes, endings, starts = tokens(batch.column(0).to_pylist())
            now = classes.of(hashes, endings)
            gathered.append((_before(hashes, starts, END), hashes, _before(now, starts, end) * size + now))
            n += len(hashes)
            if n >= GATHER:
                yield from counted()
                gathered, n = [], 0
        if n:
            yield from counted()

    found = map_arrow(docs.select("text"), run, "u long, w long, code long, c long")
    return found.groupBy("u", "w").agg(F.min("code").alias("code"), F.sum("c").alias("c"))


def _class_pairs(follows: DataFrame, size: int, customers: str) -> DataFrame:
    """``u, k, c``: customers of class k in the restaurant of class u."""
    found = follows.groupBy("code").agg(F.sum(customers).cast("long").alias("c"))
    return found.select(F.expr(f"code div {size}").alias("u"), F.expr(f"code % {size}").alias("k"), "c")


def _transitions(docs: DataFrame, classes: Classes) -> DataFrame:
    """``u, k, c``: how often class k follows class u."""
    return _class_pairs(_follows(docs, classes), classes.size, "c")


@dataclass
class Model:
    """What the tasks hold: classes, transitions, the most frequent words and pairs. All are bounded by SHARE, LOOKUP and PAIR_LOOKUP."""

    classes: Classes
    n: int
    v: int
    follow: SortedHashes
    follow_value: np.ndarray
    escape: np.ndarray
    root: np.ndarray
    words: SortedHashes
    word_count: np.ndarray
    word_logp: np.ndarray
    pairs: SortedHashes | None = None
    pair_gain: np.ndarray | None = None

    def transition(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Averaged probability of class ``now`` after ``before``."""
        out = np.zeros(len(now))
        for escape, root in zip(self.escape, self.root, strict=True):
            out += escape[before] * root[now]
        out /= len(self.root)
        found = self.follow.find(_mixed(before.astype(np.uint64) * np.uint64(self.classes.size) + now.astype(np.uint64)))
        out[found >= 0] += self.follow_value[found[found >= 0]]
        return out


def _vector(df: DataFrame, key: str, value: str, size: int) -> np.ndarray:
    """A column by class; one row per class, so bounded."""
    out = np.zeros(size)
    rows = df.select(key, value).toPandas()
    out[rows[key].to_numpy(dtype=np.int64)] = rows[value].to_numpy(dtype=np.float64)
    return out


def _transition_model(pairs: DataFrame, size: int, seed: int, burn: int, keep: int) -> tuple:
    """Gibbs over the context restaurants and the root."""
    known = pairs.agg(F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    discount, root_discount = _discount(known[0] or 0, known[1] or 0), 0.5
    total = _vector(pairs.groupBy("u").agg(F.sum("c").alias("x")), "u", "x", size)
    tables = np.bincount([], minlength=size).astype(float) + _vector(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("x")), "u", "x", size)
    arrived = _vector(pairs.groupBy("k").agg(F.count(F.lit(1)).alias("x")), "k", "x", size)
    base = np.full(size, 1 / size)
    own = np.minimum(arrived, 1)
    state = pairs.withColumn("t", F.lit(1.0))
    roots, escapes, kept = [], [], []
    for turn in range(burn + keep):
        keys = _mixed(np.arange(size, dtype=np.uint64) + np.uint64((seed * 1000 + turn) * 7919 + 1))
        own = seat(arrived, own.sum() - own, base, root_discount, keys)
        root = (np.maximum(arrived - root_discount * own, 0) + (THETA + root_discount * own.sum()) * base) / (THETA + arrived.sum())

        def run(batches: Iterator[pa.RecordBatch], root=root, tables=tables, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u, k, c, t = (batch.column(i).to_numpy() for i in range(4))
                seeds = _mixed(u.astype(np.uint64) * np.uint64(size) + k.astype(np.uint64) + np.uint64((seed * 1000 + turn) << 32))
                new = seat(c, np.maximum(tables[u] - t, 0), root[k], discount, seeds)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(new)], ["u", "k", "c", "t"])

        state = materialize(map_arrow(state.select("u", "k", "c", "t"), run, "u long, k long, c long, t double"), "seating")
        tables = _vector(state.groupBy("u").agg(F.sum("t").alias("x")), "u", "x", size)
        arrived = _vector(state.groupBy("k").agg(F.sum("t").alias("x")), "k", "x", size)
        if turn >= burn:
            roots.append(root)
            escapes.append((THETA + discount * tables) / (THETA + total))
            kept.append(state)
    rows = kept[0]
    for other in kept[1:]:
        rows = rows.unionByName(other)
    mean = rows.groupBy("u", "k").agg(F.max("c").alias("c"), F.avg("t").alias("t")).toPandas()  # at most size * size rows
    for other in kept:
        discard(other)
    u, k = mean["u"].to_numpy(dtype=np.int64), mean["k"].to_numpy(dtype=np.int64)
    value = np.maximum(mean["c"].to_numpy(dtype=np.float64) - discount * mean["t"].to_numpy(dtype=np.float64), 0) / (THETA + total[u])
    codes = _mixed(u.astype(np.uint64) * np.uint64(size) + k.astype(np.uint64))
    order = np.argsort(codes)
    return SortedHashes(codes[order]), value[order], np.array(escapes), np.array(roots)


def _word_model(counts: DataFrame, classes: Classes, seed: int, burn: int, keep: int) -> tuple[DataFrame, np.ndarray]:
    """``hash, c, logp`` of all words within their class, and the log probability of a word never seen by class."""
    size, first_rare = classes.size, len(classes.frequent)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = classes.of(batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k), batch.column(2)], ["hash", "k", "c"])

    table = materialize(map_arrow(counts.select("hash", "ending", "c"), classed, "hash long, k long, c long"), "classed-words")
    rare = table.where((F.col("k") == 0) | (F.col("k") > first_rare))
    sums = rare.groupBy("k").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    sums = materialize(sums, "class-sizes")
    customers, words = _vector(sums, "k", "c", size), _vector(sums, "k", "v", size)
    known = rare.agg(F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    discount = _discount(known[0] or 0, known[1] or 0)
    base = (1 - UNSEEN) / np.maximum(words, 1)
    tables, after = words.copy(), np.zeros(size)
    state = rare.select("hash", "k", "c", F.lit(1.0).alias("t"), F.lit(0.0).alias("kept"))
    names = ["hash", "k", "c", "t", "kept"]

    for turn in range(burn + keep):
        def run(batches: Iterator[pa.RecordBatch], tables=tables, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes, k, c, t, kept = (batch.column(i).to_numpy() for i in range(5))
                seeds = _mixed(hashes.astype(np.uint64) + np.uint64((seed * 1000 + turn + 500) * 104729))
                new = seat(c, np.maximum(tables[k] - t, 0), base[k], discount, seeds)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(new), pa.array(kept + new * (turn >= burn))], names)

        last, state = state, materialize(map_arrow(state, run, "hash long, k long, c long, t double, kept double"), "word-seating")
        discard(last)
        tables = _vector(state.groupBy("k").agg(F.sum("t").alias("t")), "k", "t", size)
        after += tables * (turn >= burn) / keep

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, c, t = (batch.column(i).to_numpy() for i in (1, 2, 4))
            p = (c - discount * t / keep + (THETA + discount * after[k]) * base[k]) / (THETA + customers[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.log10(p))], ["hash", "c", "logp"])

    alone = table.where((F.col("k") > 0) & (F.col("k") <= first_rare)).select("hash", "c", F.lit(0.0).alias("logp"))
    unseen = np.log10((THETA + discount * after) / (THETA + customers) * UNSEEN)
    model = materialize(map_arrow(state, final, "hash long, c long, logp double").unionByName(alone), "word-model")
    for written in (state, table, sums):
        discard(written)
    return model, unseen


def _class_model(pairs: DataFrame, words: DataFrame, classes: Classes, seed: int, burn: int, keep: int) -> tuple[Model, DataFrame, np.ndarray]:
    """The transitions as a model without words, and what ``_word_model`` gives."""
    pairs = materialize(pairs, "class-pairs")
    none = np.zeros(0)
    model = Model(classes, 0, 0, *_transition_model(pairs, classes.size, seed, burn, keep), SortedHashes(none.astype(np.uint64)), none, none)
    return (model, *_word_model(words, classes, seed, burn, keep))


def _seated(follows: DataFrame, contexts: DataFrame, words: DataFrame, model: Model, n: int, discount: float, seed: int, burn: int, keep: int) -> DataFrame:
    """``u, w, code, c, t, kept``: tables after the last sweep and on average of the kept ones, of the ``n`` pairs of words that follow each other at least twice.

    The parent is given, so restaurants are apart: a task makes all sweeps of its restaurants.
    """
    size, shared = model.classes.size, follows.sparkSession.sparkContext.broadcast(model)
    rows = follows.where("c > 1").join(words.select(F.col("hash").alias("w"), "logp"), "w").join(contexts.select("u", "ones"), "u")
    groups = max(1, -(-n // SEATED))
    schema = "u long, w long, code long, c long, t double, kept double"

    def run(_: tuple, rows: pa.Table) -> pa.Table:
        u, w, code, c, logp, ones = (rows[n].to_numpy() for n in ("u", "w", "code", "c", "logp", "ones"))
        parent = shared.value.transition(code // size, code % size) * 10.0**logp
        _, first, at = np.unique(u, return_index=True, return_inverse=True)
        keys, single = _pair(u.astype(np.uint64), w.astype(np.uint64)), ones[first]
        t, kept = np.ones(len(u)), np.zeros(len(u))
        for turn in range(burn + keep):
            tables = single + np.bincount(at, weights=t)
            t = seat(c, np.maximum(tables[at] - t, 0), parent, discount, _mixed(keys + np.uint64((seed * 1000 + turn + 300) * 15485863)))
            kept += t * (turn >= burn) / keep
        columns = [*(rows[n] for n in ("u", "w", "code", "c")), pa.array(t), pa.array(kept)]
        return pa.table(dict(zip([x.split()[0] for x in schema.split(", ")], columns, strict=True)))

    return materialize(rows.groupBy(F.pmod(F.xxhash64("u"), F.lit(groups))).applyInArrow(run, schema), "word-seating")


def _gains(follows: DataFrame, words: DataFrame, model: Model, discount: float, held: tuple) -> DataFrame:
    """``hash, c, logp`` of words that follow each other: by how much the log probability is above that of words never seen together.

    ``words`` has the log probability in the class (``logp``), that of going to the parent (``escape``) and the count per word; the values of words in
    ``held`` come from arrays, others are joined.
    """
    size, shared = model.classes.size, follows.sparkSession.sparkContext.broadcast((model, *held))
    schema = "hash long, c long, logp float, u long, w long, code long, kept double"
    names = [x.split()[0] for x in schema.split(", ")]

    def gained(m: Model, pair, code, c, kept, logp, escape, total) -> list[pa.Array]:
        parent = m.transition(code // size, code % size) * 10.0 ** (logp + escape)
        value = np.log10(1 + (c - discount * kept) / (THETA + total) / parent)
        return [pa.array(pair), pa.array(c), pa.array(value.astype(np.float32))]

    def pairs(u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return _pair(u.astype(np.uint64), w.astype(np.uint64)).astype(np.int64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known, count, logp, escape = shared.value
        for batch in batches:
            u, w, code, c, kept = (x.to_numpy() for x in batch.columns)
            a, b = known.find(u.astype(np.uint64)), known.find(w.astype(np.uint64))
            on = (a >= 0) & (b >= 0)
            found = gained(m, pairs(u[on], w[on]), code[on], c[on], kept[on], logp[b[on]], escape[a[on]], count[a[on]])
            yield pa.RecordBatch.from_arrays([*found, *(pa.nulls(int(on.sum()), x.type) for x in (*batch.columns[:3], batch.column(4)))], names)
            others = batch.filter(pa.array(~on))
            empty = [pa.nulls(others.num_rows, t) for t in (pa.int64(), pa.float32())]
            yield pa.RecordBatch.from_arrays([empty[0], others.column(3), empty[1], *others.columns[:3], others.column(4)], names)

    def gain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w, *rest = (x.to_numpy() for x in batch.columns)
            yield pa.RecordBatch.from_arrays(gained(shared.value[0], pairs(u, w), *rest), names[:3])

    looked = materialize(map_arrow(follows.select("u", "w", "code", "c", "kept"), look, schema), "pair-gains")
    rest = looked.where("hash IS NULL").select("u", "w", "code", "c", "kept").join(words.select(F.col("hash").alias("w"), "logp"), "w")
    rest = rest.join(words.select(F.col("hash").alias("u"), "escape", F.col("c").alias("total")), "u")
    rest = map_arrow(rest.select("u", "w", "code", "c", "kept", "logp", "escape", "total"), gain, "hash long, c long, logp float")
    return looked.where("hash IS NOT NULL").select(*names[:3]).unionByName(materialize(rest, "pair-gains"))


def _most_frequent(words: DataFrame, most: int, *columns: str):
    """Hash, count and ``columns`` of the words with the highest counts, at most ``most``; all words of one count are in or out together."""
    bins = words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("c").desc()).toPandas()  # one row per distinct count
    within = bins["n"].cumsum() <= most
    least = int(bins["c"][within].min()) if within.any() else None
    found = words.where(F.col("c") >= least if least is not None else F.lit(False)).toArrow()
    hashes = found.column("hash").to_numpy().astype(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], *(found.column(n).to_numpy()[order] for n in ("c", *columns))


def score(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, lookup: int = LOOKUP, seed: int = 0, burn: int = BURN, keep: int = KEEP,
    pair_lookup: int = PAIR_LOOKUP,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    Learns from the documents outside the held-out fold, and scores all. ``base_score`` is the smoothed unigram
    score, ``score`` the model's log10 probability; both treat a word never seen as one outcome. A null text counts as empty and
    has the end token only. A null id is in no fold: it is learned from and not held out. Repeated rows count one by one.
    """
    with setting(docs.sparkSession, CLEAN_UP, "true"):
        n, v, words, gains, local = _learned(docs, doc_id, text, share, lookup, pair_lookup, seed, burn, keep)
    base = lambda c: F.log10((c + 0.5) / F.lit(n + 0.5 * (v + 1)))
    rest = local.select("row", F.explode(F.arrays_zip("rest", "times", "unseen")).alias("x")).select("row", F.col("x.rest").alias("hash"), "x.times", "x.unseen")
    rest = rest.join(words, "hash", "left").withColumn("known", F.col("c").isNotNull())
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("known"), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * base(F.coalesce("c", F.lit(0)))).alias("more_base"),
        F.sum(F.col("times") * F.coalesce("logp", "unseen")).alias("more_score"),
    )
    pairs = local.select("row", F.explode(F.arrays_zip("pairs", "pair_times")).alias("x")).select("row", F.col("x.pairs").alias("hash"), "x.pair_times")
    pairs = pairs.join(gains.select("hash", "logp"), "hash").groupBy("row").agg(F.sum(F.col("pair_times") * F.col("logp")).alias("more_gain"))
    out = local.drop("rest", "times", "unseen", "pairs", "pair_times").join(rest, "row", "left").join(pairs, "row", "left")
    total = F.col("score") + F.coalesce("more_score", F.lit(0.0)) + F.coalesce("more_gain", F.lit(0.0))
    return out.select(
        "doc_id",
        (~_learns("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def _learned(
    docs: DataFrame, doc_id: str, text: str, share: float, lookup: int, pair_lookup: int, seed: int, burn: int, keep: int
) -> tuple[int, int, DataFrame, DataFrame, DataFrame]:
    """Numbers of tokens and of different ones, values of words and of pairs as tables, and documents scored by what the tasks hold."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text")
    )
    learn = rows.where(_learns("doc_id"))
    counts = materialize(_counts(learn), "token-counts")
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = n or 0, v or 0
    least = max(1.0, share * n)
    frequent = counts.where((F.col("c") >= least) | (F.col("hash") == int(END))).select("hash").toPandas()["hash"].to_numpy(dtype=np.int64)
    frequent = np.unique(np.append(frequent.astype(np.uint64), END))
    rare = counts.where((F.col("c") < least) & (F.col("hash") != int(END))).groupBy("ending").agg(F.sum("c").alias("c"))
    endings = np.sort(rare.where(F.col("c") >= least).select("ending").toPandas()["ending"].to_numpy(dtype=np.int64))
    classes = Classes(frequent, endings)
    follows = materialize(_follows(learn, classes), "word-pairs")
    contexts = materialize(follows.groupBy("u").agg(F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("ones")), "word-contexts")
    ones, twos, more = follows.agg(*(F.count_if(x) for x in (F.col("c") == 1, F.col("c") == 2, F.col("c") > 1))).first()
    discount = _discount(ones, twos)

    def parents(seated: DataFrame, burn: int, keep: int) -> tuple[Model, DataFrame, np.ndarray]:
        """The class levels, whose customers are the tables ``t`` of the word contexts."""
        customers = seated.groupBy(F.col("w").alias("hash")).agg(F.sum("t").cast("long").alias("c"))
        return _class_model(_class_pairs(seated, classes.size, "t"), counts.drop("c").join(customers, "hash"), classes, seed, burn, keep)

    one = F.lit(1.0)
    first, logp, _ = parents(follows.withColumn("t", one), 0, 1)
    several = _seated(follows, contexts, logp, first, more, discount, seed, burn, keep)
    discard(logp)
    discard(contexts)
    seated = follows.where("c = 1").withColumns({"t": one, "kept": one}).unionByName(several)
    class_model, logp, unseen = parents(seated, burn, keep)
    tables = seated.groupBy(F.col("u").alias("hash")).agg(F.sum("kept").alias("_kept"))
    words = counts.select("hash", "c").join(logp.select("hash", "logp"), "hash").join(tables, "hash")
    # Every token is followed by one, so the customers of a word's context are as many as its tokens.
    words = words.withColumn("escape", F.log10((THETA + discount * F.col("_kept")) / (THETA + F.col("c")))).drop("_kept")
    words = materialize(words, "words")
    discard(counts)
    discard(logp)
    hashes, count, logp, escape = _most_frequent(words, lookup, "logp", "escape")
    held = SortedHashes(hashes)
    gains = _gains(seated, words, class_model, discount, (held, count, logp, escape))
    discard(follows)
    discard(several)
    words = words.withColumn("logp", F.col("logp") + F.col("escape"))
    often, _, gain = _most_frequent(gains, pair_lookup, "logp")
    follow = class_model.follow, class_model.follow_value, class_model.escape, class_model.root
    model = Model(classes, n, v, *follow, held, count, logp + escape, SortedHashes(often), gain)
    local = materialize(_scored(rows, model, unseen), "scored-documents")
    return n, v, words, gains, local


def _others(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Order of tokens by document and hash, where a new one begins, how often each occurs, and offsets of ``n`` documents' lists."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(h)))
    return order, at, times, pa.array(np.concatenate([[0], np.cumsum(np.bincount(o[at], minlength=n))]).astype(np.int32))


def _scored(rows: DataFrame, model: Model, unseen: np.ndarray) -> DataFrame:
    """Per document what the held words and pairs give, its other words with their times and the value if never seen, and its other pairs."""
    shared = rows.sparkSession.sparkContext.broadcast((model, unseen))
    schema = (
        "doc_id long, row long, n_tokens long, n_known long, base_score double, score double, rest array<long>, times array<int>, unseen array<double>, "
        "pairs array<long>, pair_times array<int>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, never = shared.value
        z = m.n + 0.5 * (m.v + 1)
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, endings, starts = tokens(batch.column(2).to_pylist())
            now = m.classes.of(hashes, endings)
            value = np.log10(m.transition(_before(now, starts, m.classes.end), now))
            found = m.words.find(hashes)
            held = found >= 0
            value[held] += m.word_logp[found[held]]
            base = np.zeros(len(hashes))
            base[held] = np.log10((m.word_count[found[held]] + 0.5) / z)
            pair = _pair(_before(hashes, starts, END), hashes)
            met = m.pairs.find(pair)
            value[met >= 0] += m.pair_gain[met[met >= 0]]
            sizes = np.diff(np.append(starts, len(hashes)))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            # The other words and pairs, once per document.
            order, at, times, offsets = _others(owner[~held], hashes[~held], len(sizes))
            h, k = hashes[~held][order][at], now[~held][order][at]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h.astype(np.int64), times.astype(np.int32), never[k].astype(np.float64))]
            order, at, times, offsets = _others(owner[met < 0], pair[met < 0], len(sizes))
            h = pair[met < 0][order][at]
            lists += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h.astype(np.int64), times.astype(np.int32))]
            sums = [np.add.reduceat(x.astype(np.float64), starts) for x in (held, base, value)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), *lists], names
            )

    return map_arrow(rows, run, schema)
