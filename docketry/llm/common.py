"""Shared helpers of the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word bytes end at these six ASCII characters, which are also what ``bytes.split()`` splits on.
SPACE_CLASS = r"[ \t\n\x0B\f\r]"
#: Arrow batches handed to Python stay near this many bytes, whatever the length of the texts.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session in rows and bytes, so that long texts do not pile up in a worker."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int("".join(c for c in str(spark.conf.get(key)) if c.isdigit()) or 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def bucket_of(key: str, modulus: int):
    """crc32 of a number's decimal text, modulo ``modulus``; a null key gives null."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus))


def row_slices(batch: pa.RecordBatch, text_index: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most about ``most`` text bytes (one row at least)."""
    column = batch.column(text_index)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_slices(batch: pa.RecordBatch, text_index: int, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The slices of ``row_slices`` and their texts, null as empty."""
    for part in row_slices(batch, text_index, most):
        yield part, [t or "" for t in part.column(text_index).to_pylist()]


def code_points(text: str) -> np.ndarray:
    """The code points of a text as 32-bit integers."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def worker_cache() -> dict:
    """Objects that outlive a task in a reused Python worker, such as loaded vocabularies; bounded by their users."""
    name = "docketry_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def filter_rows(docs: DataFrame, keep, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, for which ``keep`` says so.

    ``keep`` gets the texts of a slice (null as empty) and returns one truth value each; it runs where the rows are.
    """
    bound_batches(docs.sparkSession)
    index = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, index):
                yield part.filter(pa.array(np.asarray(keep(texts), bool)))

    return docs.mapInArrow(run, docs.schema)
