"""From raw documents to token ids: STAGES in order, each over all that the one before kept.

1. language ID: documents in which no learned language is found (no letter, or an undecided score) go; a missing lang is filled in;
2. near-duplicates: of each component of texts linked by a five-word Jaccard similarity of 0.8 or more one document
   stays, that with the smallest id (of rows with the same id and text, the first one by its columns as JSON);
3. decontamination: documents that hold a benchmark item go;
4. personal data: spans are replaced by their kind, and n_chars is counted anew;
5. encoding: doc_id, lang, source, n_chars, n_tokens and ids of every document that is left.

Null or empty texts go in the first stage. Further columns of any name stay with their rows up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm import bpe, decontaminate, lang_id, pii, simhash
from idloom.llm.common import in_fold, table, written

#: Share of the posterior that a language must have for a document to stay.
DECIDED = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names, columns = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    text, lang, doc_id = (columns[names.index(c)] for c in ("text", "lang", "doc_id"))
    own = docs.toDF(*columns)
    learned = lang_id.learn(own, F.col(doc_id).isNotNull() & ~in_fold(doc_id, 3, 1), text, lang, doc_id)
    found = lang_id.predict(own, *learned, columns, text)
    kept = found.filter((F.col("lang_pred") != lang_id.UNDETERMINED) & (F.col("score") >= DECIDED))
    return kept.withColumn(lang, F.coalesce(lang, "lang_pred")).select(*columns).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names, columns = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    text, doc_id = (columns[names.index(c)] for c in ("text", "doc_id"))
    # a row's key also tells rows apart that share an id; without an id it sorts last
    key = F.struct(F.coalesce(F.col(doc_id), F.lit((1 << 63) - 1)).alias("i"), F.xxhash64(text).alias("h"))
    own = docs.toDF(*columns).withColumn("key", key)
    found = simhash.similar(own, "key", text)
    stay = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("rows"))
    kept = own.join(stay, "key")
    every = F.struct(*columns)
    more = kept.filter("rows > 1").groupBy("key").agg(F.min_by(every, F.to_json(every)).alias("row")).select("row.*")
    return kept.filter("rows = 1").select(*columns).unionByName(more).toDF(*names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = ["doc_id", "lang", "source", "n_chars"]
    return bpe.encoded(docs.select(*keep, "text"), keep).select(*keep, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("BPE encoding", encoding)]
ORACLE_SQL = None  # trained and edit-distance stages aren't SQL; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
