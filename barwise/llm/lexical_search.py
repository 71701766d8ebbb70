"""Ranked lexical search of a set of queries over all documents, without random access (NRA).

1. One pass over the texts counts the terms of every document and keeps, per document, its length and the counts of terms that occur
   in the queries. That table also gives the statistics of the corpus: documents, terms, documents per term.
2. Documents are taken in shards as tasks read them. A shard turns its documents into one list per term, sorted by impact (the
   share that a term adds to the score), highest first.
3. Every query reads the lists of its terms in steps, all from the top. A document that has been met has a lower bound, the impacts read,
   and an upper bound, which adds the next unread impact of every list it has not been met in. Documents that cannot reach the
   last of the best are let go. Reading ends when no unmet document can reach them either and all bounds of what is left
   have closed, so membership, ties and scores are exact.
4. A task remembers for every query the score that its last result so far has reached; later shards start from there, so that
   most lists are left after a few steps. The results of the tasks are ranked once more.

Queries are dealt into groups by hash, so that the terms of a group are bounded; each group is one pass over the table of step 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.llm.common import map_arrow
from barwise.session import materialize

TOP = 50
#: Occurrences of terms in the queries of a group; their terms are held by every task, at about 200 bytes each.
GROUP_TERMS = 200_000
#: Entries of the lists of a shard, about 20 bytes each; a document's own entries are never split.
SHARD_ENTRIES = 1_000_000
#: Entries of a list that the first step reads; steps double.
FIRST_STEP = 64
# The constants of the score.
UNIT, TF_UNIT, LENGTH_UNIT, LENGTH_BASE, LENGTH_SHARE = 1_000_000_000, 1000, 20, 50, 50
_KEEP = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256))
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else k for c, k in enumerate(_KEEP))
COUNTS = "doc_id long, n long, terms array<int>, counts array<int>"


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split() if text else []


def _utf8(table: DataFrame, id_column: str, text: str) -> DataFrame:
    return table.select(F.col(id_column).cast("long").alias("id"), F.encode(F.col(text).cast("string"), "UTF-8").alias("text"))


def _query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``row, item_id, terms`` (distinct), one row per query with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary()))], ["row", "item_id", "terms"])

    rows = _utf8(items, item_id, text).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    found = map_arrow(rows, run, "row long, item_id long, terms array<binary>").where(F.size("terms") > 0)
    return materialize(found, "query-terms")


def _counted(texts: DataFrame, vocabulary) -> DataFrame:
    """``COUNTS`` of every document with a term; ``vocabulary`` is a broadcast of terms to numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            ids, sizes, terms, counts, stops = [], [], [], [], [0]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if words:
                    found = Counter(map(number, words))
                    found.pop(None, None)
                    ids.append(i)
                    sizes.append(len(words))
                    terms += found.keys()
                    counts += found.values()
                    stops.append(len(terms))
            if ids:
                lists = [pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return materialize(map_arrow(texts, run, COUNTS), "term-counts")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Lists:
    """The impact-sorted lists of a shard."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_all: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table.column("doc_id").combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        n = table.column("n").to_numpy()
        terms = table.column("terms").combine_chunks()
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(n), dtype=np.int32), sizes)
        term, tf = terms.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        length = LENGTH_BASE + LENGTH_SHARE * n * n_docs // n_all
        impact = weights[term] * (UNIT * tf // (TF_UNIT * tf + LENGTH_UNIT * length[doc]))
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.edges = np.searchsorted(term[order], np.arange(len(weights) + 1))
        # The places of the documents by id, missing ones last, for ties.
        self.place = np.empty(len(n), dtype=np.int64)
        self.place[np.lexsort((self.ids, ~self.known))] = np.arange(len(n))

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the best ``k`` for a query, in order; those below ``least`` may be left out.

        Lists are read from the top, in steps; nothing else of them is looked at.
        """
        start, stop = self.edges[terms], self.edges[terms + 1]
        terms = terms[start < stop]
        start, stop = self.edges[terms], self.edges[terms + 1]
        n, width = len(self.ids), len(terms)
        at, step = start.copy(), FIRST_STEP
        # Where a document stands among those met; impacts read and lists met are kept for these only.
        slot = np.full(n, -1, dtype=np.int64)
        docs, lower, met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), dtype=bool)
        out, closed = np.zeros(n, dtype=bool), False  # let go; no further document can reach the best
        least = max(least, 1)
        while width:
            for j in range(width):
                part = slice(at[j], min(at[j] + step, stop[j]))
                at[j] = part.stop
                read, share = self.doc[part], self.impact[part]
                stay = ~out[read]
                read, share = read[stay], share[stay]
                fresh = read[slot[read] < 0]
                if len(fresh):
                    slot[fresh] = len(docs) + np.arange(len(fresh))
                    docs = np.concatenate([docs, fresh])
                    lower = np.concatenate([lower, np.zeros(len(fresh), np.int64)])
                    met = np.concatenate([met, np.zeros((len(fresh), width), dtype=bool)])
                where = slot[read]
                lower[where] += share
                met[where, j] = True
            step *= 2
            left = np.where(at < stop, self.impact[np.minimum(at, stop - 1)], 0)
            upper = lower + left.sum() - met @ left
            if len(lower) >= k:
                least = max(least, int(np.partition(lower, len(lower) - k)[len(lower) - k]))
            stay = upper >= least
            if not stay.all():
                out[docs[~stay]] = True
                docs, lower, met, upper = docs[stay], lower[stay], met[stay], upper[stay]
                slot[docs] = np.arange(len(docs))
            # A document that no list has shown may have up to the sum of what the lists show next.
            if not closed and left.sum() < least:
                closed = True
                out[slot < 0] = True
            if closed and (upper == lower).all():
                break
            if (at == stop).all():
                break
        order = np.lexsort((self.place[docs], -lower))[:k]
        order = order[lower[order] >= max(least, 1)] if width else order
        return docs[order], lower[order]


FOUND = "row long, doc_id long, score long"


def _searched(counts: DataFrame, queries, weights: np.ndarray, n_docs: int, n_all: int, k: int) -> DataFrame:
    """Per task the best ``k`` documents of every query; ``queries`` is a broadcast of (row, numbers of terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        held, n = [], 0

        def shard() -> Iterator[pa.RecordBatch]:
            lists = Lists(held, weights, n_docs, n_all)
            rows, ids, known, scores = [], [], [], []
            for row, terms in queries.value:
                docs, score = lists.best(terms, k, least.get(row, 1))
                if len(docs) == k:
                    least[row] = max(least.get(row, 1), int(score[-1]))
                rows.append(np.full(len(docs), row))
                ids.append(lists.ids[docs])
                known.append(lists.known[docs])
                scores.append(score)
            if rows:
                columns = [pa.array(np.concatenate(rows)), pa.array(np.concatenate(ids), mask=~np.concatenate(known)), pa.array(np.concatenate(scores))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "score"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += len(batch.column(2).flatten())
            if n >= SHARD_ENTRIES:
                yield from shard()
                held, n = [], 0
        if held:
            yield from shard()

    return map_arrow(counts, run, FOUND)


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    group_terms: int = GROUP_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best ``k`` documents with a score above 0 for every query, equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased. A null or empty text has none;
    such documents are not counted, such queries have no result. A row is a document of its own, also if it repeats an id;
    a document without an id ranks behind those of its score. Repeated queries are answered each, under the same id. Without
    documents or queries the result is empty.
    """
    spark = docs.sparkSession
    wanted = _query_terms(items, item_id, item_text)
    n_terms = wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    groups = -(-n_terms // group_terms)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for group in range(groups):
        # About ``group_terms`` terms; a group is dealt by hash, a single query is never split.
        held = wanted.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == group).toArrow()
        found = _group(docs, held, k, doc_id, text)
        names = wanted.select("row", "item_id")
        out = out.unionByName(found.join(names, "row").select("item_id", "rank", "doc_id", "score"))
    return out


def _group(docs: DataFrame, held: pa.Table, k: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    flat = held.column("terms").combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.binary()))
    numbers = {t: i for i, t in enumerate(sorted(set(flat.flatten().to_pylist())))}
    vocabulary = spark.sparkContext.broadcast(numbers)
    counts = _counted(_utf8(docs, doc_id, text), vocabulary)
    n_docs, n_all = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row per term of the group.
    df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    weights = np.zeros(max(1, len(numbers)), dtype=np.int64)
    for term, n in zip(df.column("term").to_pylist(), df.column("df").to_pylist(), strict=True):
        weights[term] = weight(n_docs, n)
    queries = spark.sparkContext.broadcast([(row, np.array([numbers[t] for t in terms], dtype=np.int64)) for row, terms in zip(held.column("row").to_pylist(), held.column("terms").to_pylist(), strict=True)])
    found = _searched(counts, queries, weights, n_docs, max(1, n_all), k)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "search-results")
