"""What the corpus operators share: folds, Arrow batches of bounded size, written tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.operators.tables import written, written_all

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "give_back", "in_fold", "map_texts", "pieces", "small_batches", "table", "token", "worker_state", "written", "written_all"]

#: Text bytes that one call of a batch function sees at most, unless one text alone is longer.
BATCH_BYTES = 2 << 20
#: Rows that Spark sends to Python at once.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, is fold. A null id is in no fold: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


_STATE: dict[str, object] = {}


def worker_state(token: str, build: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: one thing at a time, so memory stays bounded."""
    if token not in _STATE:
        _STATE.clear()
        gc.collect()
        _STATE[token] = build()
    return _STATE[token]


def token() -> str:
    return uuid.uuid4().hex


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about limit bytes of the column; no text is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def map_texts(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn over bounded pieces of df's Arrow batches."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column):
            yield fn(piece)
        give_back()

    return df.mapInArrow(run, schema)
