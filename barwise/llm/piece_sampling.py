"""SentencePiece sampling: forward filtering, backward sampling over the lattice of pieces.

The model's pieces never span the start of a run of spaces (checked when it is loaded), so the lattice of a text falls
apart into units, each a run of spaces with what follows. The lattices of all distinct units of a batch are built
and filtered together in NumPy; all occurrences are then sampled together, one piece from the end per step.
The random number of a step is a hash of the row's key, the occurrence and the step: a rerun, on any layout of
partitions, samples the same pieces. Characters without a piece become byte pieces, so decoding restores every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import map_arrow, per_process

#: The sampler's sharpness: pieces weigh probability to this power.
ALPHA = 1.0
#: Characters of texts whose lattices are built together: some 100 MB in a task.
TOGETHER = 1_000_000
SPACE = "▁"
#: Stands for a space mark that is itself part of the text; no valid text holds this code point.
LITERAL = "\udc81"
_RUN = re.compile(r" +[^ ]*|[^ ]+")
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1
SCHEMA = "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, lossless boolean"


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashTable:
    """Open addressing from 64-bit hashes to integers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.full(1 << self.bits, -2, dtype=np.int64)
        self.longest = 1
        for k, v in zip(keys.tolist(), values.tolist(), strict=True):
            at, probes = k >> (64 - self.bits), 1
            while self.values[at] != -2:
                at, probes = (at + 1) & ((1 << self.bits) - 1), probes + 1
            self.keys[at], self.values[at] = k, v
            self.longest = max(self.longest, probes)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, or -2."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.values[at], -2)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.values[at] != -2))
        for step in range(1, self.longest):
            if not len(open_):
                break
            slot = (at[open_] + step) & ((1 << self.bits) - 1)
            hit = self.keys[slot] == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            open_ = open_[~hit & (self.values[slot] != -2)]
        return out


class PieceModel:
    """Pieces, their log weights and their bytes. A piece of rank r (by score) weighs 1 / (r + 1), normalised."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        plain: dict[str, int] = {}
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        self.surface = [b""] * self.size
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.surface[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[piece] = i
                self.surface[i] = piece.replace(SPACE, " ").encode()
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces, so it cannot keep every text")
        if any(SPACE in p.lstrip(SPACE) or (p != SPACE * len(p) and p.startswith(SPACE * 2)) for p in plain):
            raise ValueError("a piece spans the start of a run of spaces")
        order = sorted(plain, key=lambda p: (-model.get_score(plain[p]), plain[p]))
        total = sum(1 / (r + 1) for r in range(len(order)))
        self.weight = np.zeros(self.size + 1)
        for r, p in enumerate(order):
            self.weight[plain[p]] = -alpha * np.log((r + 1) * total)
        self.weight[self.size] = 4 * self.weight.min()  # a character spelled in bytes
        self.longest = max(map(len, plain))
        known: dict[int, int] = {}
        for piece, i in plain.items():
            for n in range(1, len(piece)):
                known.setdefault(self.hash(piece[:n]), -1)
        for piece, i in plain.items():
            known[self.hash(piece)] = i
        self.table = HashTable(np.array(list(known), dtype=np.uint64), np.array(list(known.values()), dtype=np.int64))

    @staticmethod
    def hash(piece: str) -> int:
        h, mask = 0, _MASK
        for ch in piece:
            h = (h * int(_P) + (ord(ch) + 1) * 0xD6E8FEB86659FD93) & mask
        h ^= h >> 32
        return (h * int(_P)) & mask

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.surface[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def load(path: str, alpha: float = ALPHA) -> PieceModel:
    return per_process(("pieces", path, alpha), lambda: PieceModel(path, alpha))


def units_of(text: str) -> list[str]:
    """A text as units; the usual unit is a word, which stands for one space mark and the word. Units that begin with
    a line feed or a space mark stand for themselves."""
    if SPACE in text:
        text = text.replace(SPACE, LITERAL)
    if "  " in text or text[:1] == " " or text[-1:] == " " or " \n" in text or "\n " in text or "\n\n" in text or text[:1] == "\n":
        return [u.replace(" ", SPACE) for u in _RUN.findall(" " + text)] if text else []
    out: list[str] = []
    for line in text.split("\n"):
        words = line.split(" ")
        if out:
            words[0] = "\n" + words[0]
        out += words
    return out if text else []


def _verbatim(unit: str) -> str:
    return unit if unit[:1] in (SPACE, "\n") else SPACE + unit


class Lattices:
    """The filtered lattices of a list of distinct units. Nodes are positions in the units, laid end to end."""

    def __init__(self, model: PieceModel, units: list[str]):
        texts = [_verbatim(u) for u in units]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]  # a unit of n characters has n + 1 nodes
        self.last = self.first + lengths
        unit = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        node = np.arange(len(points), dtype=np.int32) + unit
        left = self.last[unit].astype(np.int32) - node  # characters from here to the end of the unit
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        alive = np.arange(len(points), dtype=np.int32)
        hashes = np.zeros(len(points), dtype=np.uint64)
        starts, sizes, pieces = [], [], []
        spelled = np.zeros(0, dtype=np.int32)
        for n in range(1, model.longest + 1):
            if not len(alive):
                break
            hashes = hashes * _P + mixed[alive + n - 1]
            found = model.table.get((hashes ^ (hashes >> np.uint64(32))) * _P)
            hit = found >= 0
            starts.append(node[alive[hit]])
            sizes.append(np.full(len(starts[-1]), n, dtype=np.int8))
            pieces.append(found[hit].astype(np.int32))
            if n == 1:
                spelled = alive[~hit]
            onward = (found != -2) & (left[alive] > n)
            alive, hashes = alive[onward], hashes[onward]
        # Codes from model.size on are characters spelled in bytes.
        start = np.concatenate([*starts, node[spelled]])
        size = np.concatenate([*sizes, np.ones(len(spelled), np.int8)])
        piece = np.concatenate([*pieces, model.size + points[spelled]])
        del unit, node, left, mixed, alive, hashes, starts, sizes, pieces, spelled
        end = start + size
        n_nodes = int(self.last[-1]) + 1 if len(texts) else 0
        order = np.argsort(end, kind="stable")
        start, end, piece, size = start[order], end[order], piece[order], size[order]
        weight = model.weight[np.minimum(piece, model.size)]
        # Forward: edges by how far into its unit they lead, one length at a time, so every node is reached once.
        offset = np.repeat(self.first.astype(np.int32), lengths + 1)
        reach = end - offset[end]
        del offset, order
        step = (reach.astype(np.int64) << 5) + size
        order = np.argsort(step, kind="stable").astype(np.int32)
        step = step[order]
        alpha = np.full(n_nodes, -np.inf)
        alpha[self.first] = 0.0
        cuts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])) if len(order) else []
        del reach, step
        for low, high in zip(cuts, [*cuts[1:], len(order)], strict=True):
            e = order[low:high]
            alpha[end[e]] = np.logaddexp(alpha[end[e]], alpha[start[e]] + weight[e])
        del order
        chance = np.exp(alpha[start] + weight - alpha[end])
        del weight
        self.edge_first = np.searchsorted(end, np.arange(n_nodes))
        self.edge_count = np.diff(np.append(self.edge_first, len(end)))
        total = np.cumsum(chance)
        del chance
        total -= np.concatenate([[0.0], total])[self.edge_first][end]
        self.upto = total + end  # rises from node to node + 1 over the edges into a node
        self.start, self.piece = start, piece

    def sample(self, which: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all occurrences in order, and how many each has. ``keys`` seed the occurrences."""
        at, on = self.last[which], np.flatnonzero(self.last[which] > self.first[which])
        counts = np.zeros(len(which), dtype=np.int64)
        steps = []
        n = 0
        while len(on):
            n += 1
            step = np.uint64(n * int(_P) & _MASK)
            u = (_mix(keys[on] + step) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            node = at[on]
            edge = np.searchsorted(self.upto, node + u, side="right")
            low = self.edge_first[node]
            edge = np.clip(edge, low, low + self.edge_count[node] - 1)
            steps.append((on, self.piece[edge]))
            at[on] = self.start[edge]
            counts[on] = n
            on = on[at[on] > self.first[which[on]]]
        out = np.zeros(int(counts.sum()), dtype=np.int64)
        stop = np.cumsum(counts)
        for n, (rows, found) in enumerate(steps):
            out[stop[rows] - 1 - n] = found
        return out, counts


def spell(model: PieceModel, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes beyond the pieces become the byte pieces of their character."""
    odd = np.flatnonzero(codes >= model.size)
    if not len(odd):
        return codes, counts
    distinct, back = np.unique(codes[odd], return_inverse=True)
    chars = [SPACE if chr(c - model.size) == LITERAL else chr(c - model.size) for c in distinct.tolist()]
    spelled = [model.byte_ids[np.frombuffer(c.encode("utf-8", "surrogatepass"), np.uint8)] for c in chars]
    size = np.ones(len(codes), dtype=np.int64)
    size[odd] = np.array([len(s) for s in spelled])[back]
    out = np.repeat(codes, size)
    first = np.cumsum(size) - size
    for i, s in enumerate(spelled):
        rows = first[odd[back == i]]
        for k, b in enumerate(s):
            out[rows + k] = b
    owner = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(owner, weights=size, minlength=len(counts)).astype(np.int64)


def encode(model: PieceModel, keys: list, texts: list[str | None], seed: int = 0) -> list[np.ndarray]:
    """One sampled encoding per text; ``keys`` (integers or None) seed the rows. Works on some texts at a time."""
    out: list[np.ndarray] = []
    low = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= TOGETHER or i + 1 == len(texts):
            out += _encode(model, keys[low : i + 1], texts[low : i + 1], seed)
            low, size = i + 1, 0
    return out


def _encode(model: PieceModel, keys: list, texts: list[str | None], seed: int) -> list[np.ndarray]:
    numbers: dict[str, int] = {}
    cut = [units_of(t or "") for t in texts]
    which = np.fromiter((numbers.setdefault(u, len(numbers)) for units in cut for u in units), dtype=np.int64)
    if not len(which):
        return [np.zeros(0, dtype=np.int64) for _ in texts]
    sizes = np.array([len(u) for u in cut])
    row = np.repeat(np.arange(len(cut)), sizes)
    place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    base = np.array([zlib.crc32(b"null") if k is None else k & _MASK for k in keys], dtype=np.uint64)
    base = _mix(base + np.uint64(seed * int(_P) & _MASK))
    codes, counts = Lattices(model, list(numbers)).sample(which, _mix(base[row] + place.astype(np.uint64)))
    codes, counts = spell(model, codes, counts)
    stops = np.cumsum(np.bincount(row, weights=counts, minlength=len(cut)).astype(np.int64))
    return np.split(codes, stops[:-1])


def sample(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """One row per document: ``doc_id, ids, n_pieces, ids_crc32`` (ids as little-endian uint32) and ``lossless``,
    whether decoding gives the text back.

    A null text counts as empty and has no pieces. Rows with the same id and text get the same pieces; a null id
    is a key of its own. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model, alpha)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = encode(pieces, keys, texts, seed)
            if not keys:
                continue
            same = [pieces.decode(ids.tolist()) == (t or "") for ids, t in zip(found, texts, strict=True)]
            sums = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in found]
            sizes = np.array([len(x) for x in found])
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.concatenate(found).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(same)],
                ["doc_id", "ids", "n_pieces", "ids_crc32", "lossless"],
            )

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, SCHEMA)


def decode(encoded: DataFrame, model: str, ids: str = "ids", alpha: float = ALPHA) -> DataFrame:
    """``encoded`` with the column ``text``; null ids give a null text."""

    def texts(column):
        import pandas as pd

        pieces = load(model, alpha)
        return pd.Series([None if x is None else pieces.decode(list(x)) for x in column])

    return encoded.withColumn("text", F.pandas_udf(texts, "string")(F.col(ids)))
