"""What the operators of this subpackage share: tables, held-out folds, shared staging."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.staging import dropped, shared_dir, staged  # noqa: F401  (for the operators here)

#: White space that separates words, and the rest, as regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of Arrow data that Spark hands to a Python worker at once, and of texts that a worker takes up at once.
BATCH_BYTES, PIECE_BYTES = 4 << 20, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, however long the texts are; a lower bound of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def pieces(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of column at take PIECE_BYTES together, or are one text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > PIECE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


class Memo(dict):
    """What a worker remembers while it works on a partition: the first ``limit`` bytes, or about that."""

    def __init__(self, limit: int):
        self.limit, self.held = limit, 0

    def keep(self, key: object, value: object) -> None:
        if self.held < self.limit:
            self.held += sys.getsizeof(key) + sys.getsizeof(value) + 100
            self[key] = value

    def forget(self) -> None:
        self.clear()
        self.held = 0


@cache
def _libc() -> ctypes.CDLL:
    return ctypes.CDLL(None)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *memos: Memo) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work over a partition; after it the memos are empty and freed memory goes back to the system.

    Spark keeps Python workers for later stages, where what they hold would add up.
    """

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            for memo in memos:
                memo.forget()
            released()

    return run


def released() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, UPPER, LOWER)
