"""Tables in the folder that all executors share, and functions over rows in Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session may do without one, as in tests: on a cluster
    every executor would write to its own disk."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="idloom-"))
    return f"{named.rstrip('/')}/idloom-{context.applicationId}"


_OWN: dict[str, str] = {}
_USED: set[str] = set()


def _path(spark: SparkSession) -> str:
    folder = shared_dir(spark)
    if not _USED:
        atexit.register(clear)
    _USED.add(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def clear() -> None:
    """Removes this application's intermediate tables; DataFrames that read them are no longer of use. Runs at exit."""
    spark = SparkSession.getActiveSession()
    while _USED:
        folder = _USED.pop()
        with contextlib.suppress(Exception):  # the JVM may have gone; the folder's owner then clears it
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df, computed once and kept where a lost executor doesn't lose it. by: a column that reads are pruned by."""
    spark = df.sparkSession
    path = _path(spark)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_all(parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all parts, at least one, as one table: each part is computed before the next one is asked for, so plans
    don't grow with their number."""
    path, schema, spark = None, None, None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or _path(spark)
        df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files on all cores: dealt out anew only if it has fewer partitions than there are cores, as with a few small files.
    Large inputs have more and aren't shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def _whole(x: object) -> object:
    """With every half of a surrogate pair replaced."""
    if isinstance(x, str):
        return x.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    if isinstance(x, dict):
        return {_whole(k): _whole(v) for k, v in x.items()}
    return [_whole(v) for v in x] if isinstance(x, list) else x


#: Calls of functions within one another in a task; documents are nested up to a thousand deep, in Python without using up the stack.
CALLS = 50_000


def per_row(df: DataFrame, fn: Callable[[dict], Iterator[dict] | list[dict]], schema: str, failed: Callable[[dict, str], dict] | None = None) -> DataFrame:
    """The rows that fn gives for each row. failed: the row that stands for a document on which fn fails, given the reason; no
    document ends the job."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def rows(row: dict) -> list[dict]:
        try:
            return list(fn(row))
        except Exception as e:
            if failed is None:
                raise
            return [failed(row, f"{type(e).__name__}: {e}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(CALLS)
        for batch in batches:
            out = [x for row in batch.to_pylist() for x in rows(row)]
            try:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
            except UnicodeEncodeError:  # halves of surrogate pairs, which JSON can spell and no table can hold
                yield pa.RecordBatch.from_pylist([_whole(x) for x in out], schema=arrow)

    return df.mapInArrow(run, schema)
