"""Quality rules on repetition: how much of a text lies inside n-grams and lines that it repeats.

Every text is one row and needs no other, so the rules run in the scan without a shuffle. Words become
integers; a rolling hash over them gives every n-gram of one length a number in one NumPy pass. N-grams with an equal
hash are compared word by word before they count as repeated, so the figures are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import map_arrow

#: Most part of the word characters that may lie in repeats of earlier n-grams of a length.
COVERED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most part that the most frequent n-gram may cover, where it occurs three times or more.
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
#: Most part of lines, and of characters, in lines that repeat an earlier one.
LINES, LINE_CHARS = 0.40, 0.20
#: Most part of words that equal the word before.
STUTTER = 0.30
#: Most symbols per word.
SYMBOLS = 0.10
#: The base rules: fewest words, and most per cent of words in repeated windows of eight.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
_SYMBOL = re.compile(r"[#*$%&|<>]")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars double, top_ngram double, dup_ngram double, base_failed boolean, kept boolean"
)


def _ranges(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Marks the positions of all windows of length ``n`` that start at ``starts``."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit polynomial hash of every window of ``n`` ids."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * _BASE + mixed[k : k + len(out)]
    return out


def repeated(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``n`` ids that occur twice or more, and the number of their kind, both ordered by kind."""
    none = np.zeros(0, dtype=np.int64)
    if len(ids) <= n:
        return none, none
    hashes = rolling(ids, n)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return none, none
    left, right = order[:-1][same], order[1:][same]
    if any((ids[left + k] != ids[right + k]).any() for k in range(n)):  # a collision: compare the windows themselves
        windows = np.lib.stride_tricks.sliding_window_view(ids, n)
        kind = np.unique(windows, axis=0, return_inverse=True)[1].reshape(-1)
        order = np.argsort(kind, kind="stable")
        same = kind[order][1:] == kind[order][:-1]
    kinds = np.concatenate([[0], np.cumsum(~same)])
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return order[many], kinds[many]


def measure(text: str | None) -> tuple:
    """The figures of one text, in the order of ``SCHEMA`` without the id."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    spelled = [len(w.decode("utf-8", "surrogatepass")) for w in numbers]
    chars = np.array(spelled, dtype=np.int64)[ids] if n else np.zeros(0, dtype=np.int64)
    word_chars = int(chars.sum())
    whole = max(word_chars, 1)
    # Any repeated longer window holds a repeated one of the shortest length: without those, the rest is done.
    shortest, _ = repeated(ids, min(COVERED))
    covered, repeat_words = 0.0, 0
    if len(shortest):
        for length, most in COVERED.items():
            starts, kinds = repeated(ids, length)
            if not len(starts):
                break
            later = starts[np.concatenate([[False], kinds[1:] == kinds[:-1]])]
            covered = max(covered, float(chars[_ranges(later, length, n)].sum()) / whole / most)
            if length == WINDOW:
                repeat_words = int(_ranges(starts, length, n).sum())
    top = 0.0
    for length, most in TOP.items():
        starts, kinds = repeated(ids, length)
        if not len(starts):
            break
        first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
        counts = np.diff(np.append(first, len(starts)))
        best = int(counts.max())
        if best >= 3:
            # The occurrences of one kind may overlap, so each counts up to the next one. Of tied kinds the widest counts.
            follow = np.append(np.where(kinds[1:] == kinds[:-1], starts[1:], n), n)
            upto = np.concatenate([[0], np.cumsum(chars)])
            inside = np.add.reduceat(upto[np.minimum(starts + length, follow)] - upto[starts], first)
            top = max(top, float(inside[counts == best].max()) / whole / most)
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").split()]
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in lines:
        if line in seen:
            dup_lines += 1
            dup_line_chars += len(line)
        seen.add(line)
    symbols = len(_SYMBOL.findall(text))
    line_share = dup_line_chars / max(sum(map(len, lines)), 1)
    failed = n < LEAST_WORDS or 100 * repeat_words > MOST_REPEATED * n
    kept = (
        not failed
        and covered <= 1
        and top <= 1
        and dup_lines <= LINES * len(lines)
        and line_share <= LINE_CHARS
        and symbols <= SYMBOLS * n
        and int((ids[1:] == ids[:-1]).sum()) <= STUTTER * n
    )
    return n, word_chars, symbols, dup_lines, repeat_words, float(line_share), float(top), float(covered), failed, kept


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        rows = [measure(x.as_py()) for x in batch.column(1)]
        if rows:
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with the figures of ``SCHEMA``.

    ``dup_ngram`` and ``top_ngram`` are the largest parts relative to their limits, so values above 1 break a rule.
    A null text counts as empty and fails; repeated rows are judged one by one; a null id stays null; an
    empty table gives an empty result.
    """
    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), _batches, SCHEMA)


def _verdicts(texts: pd.Series) -> pd.Series:
    return pd.Series([measure(x)[-1] for x in texts], dtype=bool)


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; the verdict is a column of the same scan."""
    return docs.where(F.pandas_udf(_verdicts, "boolean")(F.col(text).cast("string")))
