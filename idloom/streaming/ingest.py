"""Documents that arrive as a stream: identified one by one, and the last content of each id as running state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idloom.functions import columns
from idloom.operators.extraction import extracted


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """seq (by file time) and content of JSON lines that arrive in a directory."""
    lines = spark.readStream.schema(T.StructType().add("value", "string")).text(path)
    return lines.select(F.col("_metadata.file_modification_time").alias("at"), F.col("value").alias("content"))


def identified(docs: DataFrame, content: str = "content") -> DataFrame:
    """The rows with id, schema_id, is_schema and id_error: no state, and the same for streams and tables."""
    return docs.withColumn("__x", extracted(F.col(content))).select(*docs.columns, "__x.id", "__x.schema_id", "__x.is_schema", columns.error(F.col("__x.id")).alias("id_error"))


def latest(docs: DataFrame, order: str, content: str = "content") -> DataFrame:
    """id, first, last, content: the last content of each id by order. State is a row for each id, in update or complete mode."""
    return identified(docs, content).filter("id <> ''").groupBy("id").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.max_by(content, order).alias("content"))


def checked(docs: DataFrame, schemas: DataFrame, content: str = "content") -> DataFrame:
    """Stream rows with whether their schema is registered: a join with the schemas' ids as a table."""
    known = schemas.filter("is_schema").select(F.col("id").alias("schema_id"), F.lit(True).alias("schema_known"))
    return identified(docs, content).join(known, "schema_id", "left").withColumn("schema_known", F.coalesce("schema_known", F.lit(False)))
