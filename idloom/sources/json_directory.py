"""Directories of JSON documents: every *.json file holds a document or an array of documents.

Not recursive. Files that are no JSON give no documents; `rejected` lists them. Documents without an id are dropped on request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.operators.extraction import extracted


def _files(spark: SparkSession, paths: str) -> DataFrame:
    """The files of comma-separated directories; those that don't exist or are none are left out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths.split(","):
        path = hadoop(p.strip())
        fs = path.getFileSystem(conf)
        if p.strip() and fs.exists(path) and fs.getFileStatus(path).isDirectory() and fs.globStatus(hadoop(path, "*.json")):
            found.append(f"{p.strip()}/*.json")
    if not found:
        return spark.createDataFrame([], "value string, file string, v variant")
    raw = spark.read.text(found, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return raw.withColumn("v", F.try_parse_json("value"))


def read_documents(spark: SparkSession, paths: str, need_id: bool = True) -> DataFrame:
    """file, pos (in an array), content."""
    files = _files(spark, paths).filter("v is not null")
    is_array = F.schema_of_variant("v").startswith("ARRAY")
    single = files.filter(~is_array).select("file", F.lit(0).alias("pos"), F.col("value").alias("content"))
    # elements keep their text where it can be told apart: as strings of the file's own array
    many = files.filter(is_array).select("file", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "content"))
    docs = single.unionByName(many)
    return docs.filter(extracted(F.col("content"))["id"] != "") if need_id else docs


def rejected(spark: SparkSession, paths: str) -> DataFrame:
    """The files that aren't JSON."""
    return _files(spark, paths).filter("v is null").select("file")
