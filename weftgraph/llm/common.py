"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from importlib.util import find_spec
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.session import ship

#: White space between words and around lines: space and the controls 9 to 13.
WS = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word, as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"


def vocabulary_file(name: str) -> str:
    """Where a file of the public vocabularies lies; without these, the bare name, so that only queries that read it fail."""
    found = find_spec("public_tokenizers")
    return str(Path(found.origin).parent / name) if found else name


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased; bytes.split() splits at WS alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def n_words(text: Column) -> Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20):
    """The batch cut so that each cut's texts stay near ``max_bytes``: bounds a Python worker's memory."""
    n = batch.num_rows
    if n == 0:
        return
    per_row = max(1, batch.column(batch.schema.get_field_index(column)).nbytes // n)
    step = max(1, max_bytes // per_row)
    for i in range(0, n, step):
        yield batch.slice(i, min(step, n - i))


def append_columns(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """The schema of ``df`` with ``fields`` put in; a clashing name of ``df`` gives way."""
    ship(df.sparkSession)
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + fields)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns named so, whatever their case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


#: A side of a join goes to every task only if it was counted to have at most so many rows.
SMALL = 20_000


def if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, to be broadcast if a count finds few rows; else a plain side of a join, which Spark deals by key and splits where skewed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_keeper: list = [None, None]


def give_back() -> None:
    """Return free memory to the system: workers live on after a task, beside the next one's JVM work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim with


def tidy(run, name: str = "", forget=None):
    """``run``, a function for mapInArrow, so that a worker gives memory back when a task ends.

    Tables that a worker keeps for its next task under ``name`` are dropped by ``forget``
    once a task of another name runs in it.
    """

    def tidied(batches):
        if _keeper[0] != name and _keeper[1] is not None:
            _keeper[1]()
        _keeper[:] = name, forget
        yield from run(batches)
        give_back()

    return tidied
