"""Column helpers and table access shared by the text operators.

An operator takes the columns it needs by name and computes on a table of its own, so further columns of
the input, also those named like a result column, neither disturb it nor get lost where rows are returned.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of all word counts (space and the controls 09 to 0D), the letters that lower-casing maps.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Rows of one Arrow batch. Texts average a few kB, so a batch stays at some MB; Spark also ends a batch by its bytes.
BATCH_ROWS = 2000


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies: in the folder of ``PUBLIC_TOKENIZERS`` if set, else in the installed package."""
    if folder := os.environ.get("PUBLIC_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def unused(df: DataFrame, *names: str) -> str | list[str]:
    """The names, each lengthened until ``df`` has no such column (case does not tell names apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out if len(out) > 1 else out[0]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null stays null. ASCII texts take the faster built-in."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def folds(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo ``n``: the fold of a document; null for a null id."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(n))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: ``bytes.split`` cuts at exactly the white space of ``WORD``."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).split() if text else []


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """``make()``, once per Python process: tasks that follow each other in a worker share what is costly to build."""
    store = sys.modules.setdefault("_text_operators", types.ModuleType("_text_operators")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(fn, schema)
