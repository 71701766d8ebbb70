"""Language identification by interpolated Kneser-Ney character models.

Texts are reduced to lower-case letters and single spaces. Per language, Spark counts the distinct longest n-grams
of a sample of labelled texts with a documented bound, so the model has a bounded size however large the corpus is.
All lower orders follow from them: continuation counts are numbers of distinct longer n-grams. The n-grams of all languages of
one order form one sorted array of hashes with a row of log probabilities, so a position costs one search
in all languages together; only where no language has seen the n-gram does the next lower order count.

The language with the lowest cross-entropy per character wins. Part of the sample is left out of the
counts; it calibrates the sharpness of the scores and, per language, the entropy from which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import folds, map_arrow
from barwise.session import materialize

#: Longest n-gram, characters of a language that the sample holds on average at most, quantile beyond which texts are rejected.
ORDER, SAMPLE_CHARS, ACCEPTED = 5, 2_000_000, 0.999
UNKNOWN = "und"
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_SLICE = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def letters(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as code points, each led by ``order`` - 1 zeros and a space, and the end of each text.

    Letters are lower case; everything else is one space per run. A text without letters has no characters at all.
    """
    raw = np.frombuffer("\x00".join([" " + (t or "").lower().replace("\x00", " ") + " " for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    kinds = np.zeros(int(raw.max(initial=0)) + 1, dtype=bool)
    present = np.flatnonzero(np.bincount(raw)) if len(raw) else []
    kinds[[c for c in present if chr(c).isalpha()]] = True
    letter = kinds[raw] if len(raw) else np.zeros(0, bool)
    text = np.cumsum(raw == 0) if len(raw) else np.zeros(0, np.int64)
    some = np.bincount(text, weights=letter, minlength=len(texts)) > 0
    points = np.where(letter, raw, 32)
    keep = (raw != 0) & some[text] & (letter | np.concatenate([[True], letter[:-1] | (raw[:-1] == 0)]))
    points, text = points[keep], text[keep]
    sizes = np.bincount(text, minlength=len(texts))
    pad = np.where(sizes > 0, order - 1, 0)
    out = np.zeros(len(points) + int(pad.sum()), dtype=np.int64)
    out[np.arange(len(points)) + np.cumsum(pad)[text]] = points
    return out, np.cumsum(sizes + pad)


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """The hash of the last ``n`` characters up to every position (fewer at the start)."""
    out = np.zeros(len(points), dtype=np.uint64)
    scale = np.uint64(1)
    base = points.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(min(n, len(points))):
            out[k:] += base[: len(points) - k] * scale
            scale = scale * _P
    return _mixed(out)


class SortedHashes:
    """Positions of hashes in a sorted array; the leading bits say where to begin."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, min(20, int(len(keys)).bit_length()))
        top = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << self.bits) + 1)).astype(np.int64)
        self.longest = int(np.diff(self.first).max(initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Positions, or -1."""
        out = np.full(len(wanted), -1, dtype=np.int64)
        top = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        open_ = np.flatnonzero(at < stop)
        for k in range(self.longest):
            if not len(open_):
                break
            here = at[open_] + k
            hit = self.keys[here] == wanted[open_]
            out[open_[hit]] = here[hit]
            open_ = open_[~hit & (here + 1 < stop[open_])]
        return out


@dataclass
class Model:
    """Per order the sorted n-grams with log probabilities and the sorted contexts with log back-off weights."""

    languages: list[str]
    order: int
    grams: list[SortedHashes]
    logp: list[np.ndarray]
    contexts: list[SortedHashes | None]
    backoff: list[np.ndarray | None]
    unseen: np.ndarray
    sharpness: float = 1.0
    limits: np.ndarray | None = None

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per character, texts by languages, and the number of characters (0: no letter)."""
        points, ends = letters(texts, self.order)
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.zeros((len(texts), len(self.languages)))
        counts = np.maximum(ends - starts - (self.order - 1), 0)
        hashes = [gram_hashes(points, n) for n in range(self.order + 1)]
        owner = np.repeat(np.arange(len(texts)), ends - starts)
        real = np.flatnonzero(points != 0)
        for low in range(0, len(real), _SLICE):
            at = real[low : low + _SLICE]
            value = np.zeros((len(at), len(self.languages)), dtype=np.float32)
            todo = np.arange(len(at))
            for n in range(self.order, 0, -1):
                found = self.grams[n].find(hashes[n][at[todo]])
                hit = found >= 0
                value[todo[hit]] += self.logp[n][found[hit]]
                todo = todo[~hit]
                if not len(todo):
                    break
                if n > 1:
                    context = self.contexts[n].find(hashes[n - 1][at[todo] - 1])
                    value[todo[context >= 0]] += self.backoff[n][context[context >= 0]]
            value[todo] += self.unseen
            edge = np.flatnonzero(np.concatenate([[True], owner[at][1:] != owner[at][:-1]]))
            np.add.at(sums, owner[at][edge], np.add.reduceat(value.astype(np.float64), edge, axis=0))
        return -sums / np.maximum(counts, 1)[:, None], counts


def _train(rows: dict[str, np.ndarray], languages: list[str], order: int) -> Model | None:
    """``rows``: per distinct longest n-gram its language, count ``n``, and hashes ``h1..hN`` and contexts ``c2..cN``."""
    if not len(rows["n"]):
        return None
    grams, logp, contexts, backoff = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
    n_lang = len(languages)
    # From the longest down: distinct n-grams per language with counts (continuation counts below the longest).
    levels = {}
    lang, count = rows["lang"], rows["n"].astype(np.float64)
    pick = np.arange(len(lang))
    for n in range(order, 0, -1):
        h = rows[f"h{n}"][pick]
        key = np.lexsort((h, lang))
        new = np.concatenate([[True], (h[key][1:] != h[key][:-1]) | (lang[key][1:] != lang[key][:-1])]) if len(key) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=count[key])
        first = key[new]
        levels[n] = (lang[first], h[first], total, pick[first])
        lang, pick, count = lang[first], pick[first], np.ones(len(first))
    for n in range(1, order + 1):
        lang, h, total, at = levels[n]
        ones, twos = (total == 1).sum(), (total == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        union, where = np.unique(h, return_inverse=True)
        table = np.zeros((len(union), n_lang))
        if n == 1:
            mass = np.bincount(lang, weights=total, minlength=n_lang)
            kinds = np.bincount(lang, minlength=n_lang)
            rest = np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 1.0)
            flat = rest / (len(union) + 1)
            table[where, lang] = np.maximum(total - discount, 0) / mass[lang]
            table += flat
            unseen = np.log(flat).astype(np.float32)
        else:
            context = rows[f"c{n}"][at]
            spaces, cwhere = np.unique(context, return_inverse=True)
            slot = cwhere * n_lang + lang
            mass = np.bincount(slot, weights=total, minlength=len(spaces) * n_lang)
            kinds = np.bincount(slot, minlength=len(spaces) * n_lang)
            weight = np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 1.0).reshape(-1, n_lang)
            table[where, lang] = np.maximum(total - discount, 0) / mass[slot]
            one = np.zeros(len(union), dtype=np.int64)
            one[where] = np.arange(len(h))
            shorter = grams[n - 1].find(rows[f"h{n - 1}"][at[one]])
            table += weight[cwhere[one]] * np.exp(logp[n - 1][shorter].astype(np.float64))
            contexts[n], backoff[n] = SortedHashes(spaces), np.log(weight).astype(np.float32)
        grams[n], logp[n] = SortedHashes(union), np.log(table).astype(np.float32)
    return Model(languages, order, grams, logp, contexts, backoff, unseen)


def _count(sample: DataFrame, order: int) -> DataFrame:
    """Distinct longest n-grams per language (``lang`` is its number) with counts and the hashes of their parts."""
    names = [f"h{n}" for n in range(1, order + 1)] + [f"c{n}" for n in range(2, order + 1)]
    schema = "lang int, n long, " + ", ".join(f"{x} long" for x in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_numpy()
            texts = batch.column(1).to_pylist()
            for lang in np.unique(langs):
                points, _ = letters([texts[i] for i in np.flatnonzero(langs == lang)], order)
                hashes = [gram_hashes(points, n) for n in range(order + 1)]
                at = np.flatnonzero(points != 0)
                if not len(at):
                    continue
                _, first, counts = np.unique(hashes[order][at], return_index=True, return_counts=True)
                at = at[first]
                columns = [hashes[n][at] for n in range(1, order + 1)] + [hashes[n - 1][at - 1] for n in range(2, order + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), lang, np.int32)), pa.array(counts.astype(np.int64)), *(pa.array(c.astype(np.int64)) for c in columns)], ["lang", "n", *names]
                )

    counted = map_arrow(sample.select("lang", "text"), run, schema)
    rest = [x for x in names if x != f"h{order}"]
    return counted.groupBy("lang", f"h{order}").agg(F.sum("n").alias("n"), *[F.min(x).alias(x) for x in rest])


def fit(
    labelled: DataFrame, order: int = ORDER, sample_chars: int = SAMPLE_CHARS, accepted: float = ACCEPTED,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> Model | None:
    """A model from labelled rows; None if no row has a language, an id and letters.

    Rows are sampled per language by a hash of the id, so that a language gives about ``sample_chars`` characters
    of whole texts. A fifth of the sample (by another hash) calibrates.
    """
    rows = labelled.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    chars = materialize(rows.groupBy("lang").agg(F.sum(F.char_length("text")).alias("chars")), "language-sizes")
    languages = sorted((r[0] for r in chars.select("lang").collect()), key=lambda x: x.encode())  # one row per language
    if not languages:
        return None
    share = (F.shiftrightunsigned(F.xxhash64(F.lit(4), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    sample = rows.join(chars, "lang").where(share * F.col("chars") <= sample_chars).drop("chars")
    number = (F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1).cast("int")
    sample = sample.select("text", number.alias("lang"), F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)).alias("part"))
    sample = materialize(sample, "language-sample")
    model = _train(_columns(_count(sample.where("part > 0"), order)), languages, order)
    if model is None:
        return None
    judged = _entropies(sample.where("part = 0"), model, "lang").toPandas()
    _calibrate(model, judged, accepted)
    return model


def _calibrate(model: Model, judged, accepted: float) -> None:
    """Sharpness by the least log loss on a grid; limits by the quantile of the true language's entropy."""
    model.limits = np.full(len(model.languages), np.inf)
    judged = judged[judged["n"] > 0]
    if not len(judged):
        return
    table = np.stack(judged["entropies"].to_numpy())
    true = judged["lang"].to_numpy()
    losses = {}
    for sharp in np.geomspace(0.5, 200, 25):
        scaled = -sharp * (table - table.min(axis=1, keepdims=True))
        losses[sharp] = float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(true)), true]).mean())
    model.sharpness = min(losses, key=losses.get)
    for k in range(len(model.languages)):
        if (true == k).any():
            model.limits[k] = np.quantile(table[true == k, k], accepted)


def _columns(counts: DataFrame) -> dict[str, np.ndarray]:
    """The counted n-grams as arrays; the sample bounds them to one row per character."""
    table = counts.toArrow()
    return {name: table.column(name).to_numpy().astype(np.uint64 if name[0] in "hc" else np.int64) for name in table.column_names}


def _entropies(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [f.simpleString().replace(":", " ") for f in rows.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, counts = shared.value.entropies(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(list(table), pa.list_(pa.float64())), pa.array(counts.astype(np.int64))], [*keep, "entropies", "n"]
            )

    return map_arrow(rows.select(*keep, "text"), run, ", ".join(kept) + ", entropies array<double>, n long")


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score, accepted``.

    ``und`` with score 0 where the text is null or has no letter, or where no language was learned. ``accepted`` is
    false there and where the entropy exceeds the language's limit; the nearest language is given all the same.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            table, counts = m.entropies(batch.column(1).to_pylist())
            best = table.argmin(axis=1)
            odds = np.exp(-m.sharpness * (table - table.min(axis=1, keepdims=True)))
            some = counts > 0
            score = np.where(some, 1 / odds.sum(axis=1), 0.0)
            names = [m.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
            within = some & (table[np.arange(len(best)), best] <= m.limits[best])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(score), pa.array(within)], ["doc_id", "lang_pred", "score", "accepted"])

    return map_arrow(rows, run, "doc_id long, lang_pred string, score double, accepted boolean")


def held_out(doc_id: str = "doc_id"):
    """Whether a document belongs to the fold that is never learned from; a null id belongs to no fold."""
    return F.coalesce(folds(F.col(doc_id)) == 0, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold and predict every row: ``doc_id, held_out, lang_pred, score, accepted``."""
    model = fit(docs.where(~held_out(doc_id)), doc_id=doc_id, text=text, lang=lang, **options)
    out = predict(docs, model, doc_id, text)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")
