"""Token ids in binary files of patched frame-of-reference blocks.

One task writes one file with the documents of a range of ids, so the files in order are the corpus in order,
and no task sees more than its range. A file is streamed: at most one group of blocks is held. It is written
under a name of the attempt and then renamed, so a task that runs again, or twice, leaves the same file.

File format, little-endian: the magic bytes; blocks of ``BLOCK`` ids (the last may be shorter); the index with the
byte offset of every block (uint64), then ids (int64), presence of the id (uint8) and lengths (uint32) of the documents;
the trailer with the numbers of blocks, documents and tokens and the offset of the index (uint64 each), magic bytes.
A block: number of ids (uint16), bits per packed value (uint8), zero (uint8), number of exceptions (uint32), minimum (uint32);
packed differences from the minimum, most significant bit first, padded to whole bytes; positions of exceptions
(uint16) and their differences (uint32). The width holds the given percentile of the block's differences.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.llm.common import map_arrow, per_process
from barwise.session import materialize

MAGIC = b"PFORIDS1"
BLOCK, GROUP = 1024, 256
PERCENTILE = 90
END_ID = 0
#: Pieces whose ids a worker keeps: some 50 bytes each.
KEPT_PIECES = 800_000
#: Two characters in a row that Unicode counts as white space.
DOUBLE_SPACE = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]{2}"
#: New words that are encoded as one text.
TOGETHER = 256
_HEAD, _TAIL = "<HBBII", "<QQQQ8s"
_HEAD_BYTES, _TAIL_BYTES = struct.calcsize(_HEAD), struct.calcsize(_TAIL)
FILES = "file long, path string, n_docs long, n_tokens long"
DOCS = "file long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class TextEncoder:
    """Ids of texts as bytes of uint32, equal to the tokenizer's own.

    The tokenizer's pattern never joins characters across a single space or line feed between other
    characters, so a text may be encoded in pieces cut there, and frequent pieces are encoded once. A
    text with two white-space characters in a row is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # Ids of pieces: of words after a space, and of line feeds with the word that begins the line.
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.feed_id = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.feed = self._encode(["\n"])[0]
        marks = list(".,;:!?")
        self.marks, self.mark_ids = pa.array(["", *marks], pa.large_string()), pa.array([b"", *self._encode(marks)], pa.large_binary())

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [_packed(x.ids) for x in found]

    def _words(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of words that hold no space and no line feed: many are encoded as the lines of one text and cut at the line feeds, whose id
        stands for nothing else. Words with white space at an end would join the line feed, and are encoded one by one."""
        odd = [i for i, w in enumerate(words) if w[:1].isspace() or w[-1:].isspace() or not w]
        alone = dict(zip(odd, self._encode([lead + words[i] for i in odd]), strict=True))
        lined = [w for i, w in enumerate(words) if i not in alone] if odd else words
        texts = [lead + f"\n{lead}".join(lined[i : i + TOGETHER]) for i in range(0, len(lined), TOGETHER)]
        out: list[bytes] = []
        for start, found in zip(range(0, len(lined), TOGETHER), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            data, feeds = ids.tobytes(), (np.flatnonzero(ids == self.feed_id) * 4).tolist()
            out += [data[a:b] for a, b in zip([0, *(x + 4 for x in feeds)], [*feeds, len(data)], strict=True)]
            if len(out) != min(start + TOGETHER, len(lined)):
                raise ValueError("line feeds do not separate words in this vocabulary")
        if odd:
            rest = iter(out)
            out = [alone[i] if i in alone else next(rest) for i in range(len(words))]
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of every text; a null is an empty text.

        A text is cut before every line feed and at every space. So a piece that begins with a line feed is that and the first word of a
        line, any other is a word after a space. One more line feed is put before the text, and its id left out.
        """
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, DOUBLE_SPACE)
        # The empty texts in place of those that are encoded as a whole keep the places.
        cut = pc.if_else(whole, pa.scalar("", pa.large_string()), texts)
        marked = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(cut, "\n", " \n"), pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(marked, " ")
        pieces = lists.flatten().dictionary_encode()
        values = self._pieces(pieces.dictionary).take(pieces.indices)
        # The taken values lie end to end, so they are the texts' ids already.
        _, offsets, data = values.buffers()
        starts = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
        ends = starts[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        data = memoryview(data) if data is not None else b""
        out = [bytes(data[a + 4 : b]) for a, b in zip(ends, ends[1:])]
        rest = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        for i, ids in zip(rest, self._encode(texts.take(pa.array(rest, pa.int64())).to_pylist()), strict=True):
            out[i] = ids
        return out

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of different pieces. A mark after a letter is a token of its own, so the piece before it is looked up apart."""
        ended = pc.match_substring_regex(pieces, r"\p{L}[.,;:!?]$")
        plain = pc.if_else(ended, pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
        mark = pc.index_in(pc.if_else(ended, pc.utf8_slice_codeunits(pieces, -1), pa.scalar("", pa.large_string())), self.marks)
        ids = self._plain(plain.dictionary).take(plain.indices)
        return pc.binary_join_element_wise(ids, self.mark_ids.take(mark), pa.scalar(b"", pa.large_binary()))

    def _plain(self, pieces: pa.Array) -> pa.Array:
        """Ids of different pieces; new ones are kept as far as ``KEPT_PIECES`` allows."""
        place = pc.index_in(pieces, self.known)
        missing = pc.is_null(place)
        new = pieces.filter(missing)
        words = np.array(new.to_pylist(), dtype=object)
        first = np.array([w[:1] == "\n" for w in words], dtype=bool)
        made = np.empty(len(words), dtype=object)
        made[~first] = self._words(words[~first].tolist(), " ")
        made[first] = [self.feed + ids for ids in self._words([w[1:] for w in words[first]], "")]
        made = pa.array(made.tolist(), pa.large_binary())
        n = len(self.known)
        rank = pc.add(pc.cumulative_sum(missing.cast(pa.int64())), n - 1)
        out = pa.concat_arrays([self.ids, made]).take(pc.if_else(missing, rank, place.cast(pa.int64())))
        if n < KEPT_PIECES:
            self.known = pa.concat_arrays([self.known, new.slice(0, KEPT_PIECES - n)])
            self.ids = pa.concat_arrays([self.ids, made.slice(0, KEPT_PIECES - n)])
        return out


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of the given ids; all but the last are full."""
    out = []
    full = len(ids) // BLOCK * BLOCK
    tables = ([ids[:full].reshape(-1, BLOCK)] if full else []) + ([ids[full:].reshape(1, -1)] if full < len(ids) else [])
    for table in tables:
        low = table.min(axis=1)
        rest = table - low[:, None]
        rank = min(table.shape[1] - 1, int(np.ceil(percentile / 100 * table.shape[1])) - 1)
        widths = np.array([int(x).bit_length() for x in np.partition(rest, rank, axis=1)[:, rank]])
        packed: list[bytes] = [b""] * len(table)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            if width:
                bits = np.unpackbits(rest[rows].astype(">u4").view(np.uint8).reshape(len(rows), -1, 4), axis=2)
                lines = np.packbits(bits[:, :, 32 - width :].reshape(len(rows), -1), axis=1)
                for r, line in zip(rows, lines, strict=True):
                    packed[r] = line.tobytes()
            for r in rows:
                odd = np.flatnonzero(rest[r] >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
                head = struct.pack(_HEAD, table.shape[1], width, 0, len(odd), int(low[r]))
                packed[r] = head + packed[r] + odd.astype("<u2").tobytes() + rest[r][odd].astype("<u4").tobytes()
        out += packed
    return out


def unpack_block(data: memoryview | bytes) -> np.ndarray:
    n, width, _, odd, low = struct.unpack_from(_HEAD, data)
    size = (n * width + 7) // 8
    values = np.zeros((n, 4), dtype=np.uint8)
    if width:
        bits = np.zeros((n, 32), dtype=np.uint8)
        bits[:, 32 - width :] = np.unpackbits(np.frombuffer(data, np.uint8, size, _HEAD_BYTES), count=n * width).reshape(n, width)
        values = np.packbits(bits, axis=1)
    out = values.view(">u4").reshape(-1).astype(np.uint32)
    at = _HEAD_BYTES + size
    out[np.frombuffer(data, "<u2", odd, at).astype(np.int64)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    return out + np.uint32(low)


class _Writer:
    def __init__(self, folder: str, number: int):
        self.number = number
        self.store, base = fs.FileSystem.from_uri(folder)
        self.path = f"{base}/ids-{number:06d}.pfor"
        self.attempt = f"{base}/_attempt-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.attempt)
        self.out.write(MAGIC)
        self.at, self.tokens = len(MAGIC), 0
        self.held: list[bytes] = []
        self.n_held = 0
        self.offsets, self.ids, self.there, self.lengths = [], [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.there.append(doc_id is not None)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= BLOCK * GROUP:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        held = np.frombuffer(b"".join(self.held), "<u4").astype(np.uint32)
        for block in pack_blocks(held[:n]):
            self.offsets.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.tokens += n
        self.held, self.n_held = [held[n:].astype("<u4").tobytes()], len(held) - n

    def close(self) -> tuple:
        if self.n_held:
            self._flush(self.n_held)
        for values, kind in ((self.offsets, "<u8"), (self.ids, "<i8"), (self.there, "u1"), (self.lengths, "<u4")):
            self.out.write(np.array(values, dtype=kind).tobytes())
        self.out.write(struct.pack(_TAIL, len(self.offsets), len(self.ids), self.tokens, self.at, MAGIC))
        self.out.close()
        self.store.move(self.attempt, self.path)
        return self.number, self.path, len(self.ids), self.tokens


def write(
    docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, files: int | None = None
) -> DataFrame:
    """Encode the texts and write them in ascending order of ids; returns one row per file (``FILES``).

    A null text is an empty one and leaves only the end id. A null id sorts first and stays null. Rows with
    the same id stand in the order of their texts. An empty table writes no file.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = None, None
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or per_process(("encoder", tokenizer), lambda: TextEncoder(tokenizer))
            writer = writer or _Writer(folder, TaskContext.get().partitionId())
            for i, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                writer.add(i, ids + end)
        if writer:
            row = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["file", "path", "n_docs", "n_tokens"])

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ranged = rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")
    return materialize(map_arrow(ranged.sortWithinPartitions("doc_id", "text"), save, FILES), "token-files")


def read_file(folder: str, path: str, group: int = GROUP) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of one file in order: id and token ids. Holds one group of blocks and one document."""
    store, _ = fs.FileSystem.from_uri(folder)
    with store.open_input_file(path) as source:
        size = source.size()
        n_blocks, n_docs, _, index, magic = struct.unpack(_TAIL, source.read_at(_TAIL_BYTES, size - _TAIL_BYTES))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        table = source.read_at(size - _TAIL_BYTES - index, index)
        offsets = np.append(np.frombuffer(table, "<u8", n_blocks), index).astype(np.int64)
        ids = np.frombuffer(table, "<i8", n_docs, 8 * n_blocks)
        there = np.frombuffer(table, "u1", n_docs, 8 * (n_blocks + n_docs))
        lengths = np.frombuffer(table, "<u4", n_docs, 8 * n_blocks + 9 * n_docs).astype(np.int64)
        held, block = np.zeros(0, np.uint32), 0
        at = 0
        for doc, known, length in zip(ids.tolist(), there.tolist(), lengths.tolist(), strict=True):
            parts = []
            need = length
            while need > len(held) - at:
                parts.append(held[at:])
                need -= len(held) - at
                last = min(block + group, n_blocks)
                data = source.read_at(int(offsets[last] - offsets[block]), int(offsets[block]))
                base = offsets[block]
                held = np.concatenate([unpack_block(memoryview(data)[int(o - base) :]) for o in offsets[block:last]])
                at, block = 0, last
            parts.append(held[at : at + need])
            at += need
            yield doc if known else None, np.concatenate(parts) if len(parts) > 1 else parts[0]


def read(files: DataFrame, folder: str) -> DataFrame:
    """One row per document, read back from the files: ``DOCS``, checksums over the ids as little-endian uint32."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DOCS.split(", ")]
        for batch in batches:
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, start = [], 0
                for doc, ids in read_file(folder, path):
                    rows.append((number, doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    spread = files.select("file", "path").repartition(max(1, files.count()))
    return map_arrow(spread, load, DOCS)


def document_index(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: starts count over all files, whose totals are one small row each."""
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    return read(files, folder).join(starts, "file").select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
