"""A live source of ticks: a growing log of text lines, read as a stream with offsets and partitions of its own.

Feeds append lines ``epoch microseconds,symbol,bid,ask`` to files of one folder. An offset is the number of bytes of each file up to its last
whole line, so lines that are still being written wait for the next batch, files may grow between batches, and a query that is
started again goes on where its checkpoint ends. Ranges of at most ``split`` bytes are read by different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

COLUMNS = {"micros": pa.int64(), "symbol": pa.string(), "bid": pa.float64(), "ask": pa.float64()}
SCHEMA = "micros long, symbol string, bid double, ask double"
SPLIT = 32 << 20
STEP = 1 << 16


class Range(InputPartition):
    """Bytes ``[start, stop)`` of a file."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _next_line(file, at: int, size: int) -> int:
    """The first place from ``at`` on where a line begins."""
    if at == 0:
        return 0
    file.seek(at - 1)
    place = at - 1
    while place < size:
        piece = file.read(min(STEP, size - place))
        if (found := piece.find(b"\n")) >= 0:
            return place + found + 1
        place += len(piece)
    return size


def _whole_lines(store, path: str, start: int, size: int) -> int:
    """The end of the last whole line, looked for backwards; ``start`` where none ends after it."""
    with store.open_input_file(path) as file:
        stop = size
        while stop > start:
            low = max(start, stop - STEP)
            file.seek(low)
            if (found := file.read(stop - low).rfind(b"\n")) >= 0:
                return low + found + 1
            stop = low
    return start


class TickLogReader(DataSourceStreamReader):
    def __init__(self, folder: str, split: int):
        self.folder, self.split, self.known = folder, split, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, folder = fs.FileSystem.from_uri(self.folder)
        ends = {}
        for found in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if found.is_file and not found.base_name.startswith(("_", ".")):
                before = self.known.get(found.path, 0)
                ends[found.path] = _whole_lines(store, found.path, before, found.size) if found.size > before else before
        self.known = {path: end for path, end in ends.items() if end}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [
            Range(path, at, min(at + self.split, stop))
            for path, stop in sorted(end.items())
            for at in range(start.get(path, 0), stop, self.split)
        ]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the range; the last one may end after it."""
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(partition.path) as file:
            size = file.size()
            start, stop = (_next_line(file, at, size) for at in (partition.start, partition.stop))
            file.seek(start)
            lines = file.read(stop - start)
        if lines:
            names = pyarrow.csv.ReadOptions(column_names=list(COLUMNS), use_threads=False)
            types = pyarrow.csv.ConvertOptions(column_types=COLUMNS, strings_can_be_null=False)
            yield from pyarrow.csv.read_csv(pa.BufferReader(lines), read_options=names, convert_options=types).to_batches()


class TickLog(DataSource):
    """Options ``path`` (the folder) and ``split`` (bytes per task)."""

    @classmethod
    def name(cls) -> str:
        return "ticklog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TickLogReader(self.options["path"], int(self.options.get("split", SPLIT)))


def tick_log(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """The stream of ticks ``time, symbol, bid, ask`` of a log."""
    spark.dataSource.register(TickLog)
    rows = spark.readStream.format("ticklog").option("path", folder).option("split", split).load()
    return rows.select(F.timestamp_micros("micros").alias("time"), "symbol", "bid", "ask")


def log_lines(ticks: DataFrame) -> DataFrame:
    """Ticks as the lines of a log."""
    return ticks.select(F.concat_ws(",", F.unix_micros("time").cast("string"), "symbol", F.col("bid").cast("string"), F.col("ask").cast("string")).alias("value"))
