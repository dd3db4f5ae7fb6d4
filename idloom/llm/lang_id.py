"""Language identification by prediction by partial matching.

For every language a byte context tree is learned; a text's language is the one under whose frozen tree
its code length is least. Learning uses a bounded sample: about `sample` documents for each language,
chosen by a hash of the id, their whole texts counted on the executors. What reaches the driver are
window counts of that sample, so their size doesn't follow the input.

Nulls, empty and odd input: a null text, or one without a letter, gets `und` with score 0. With no
learned language at all every text gets `und`. Null languages aren't learned. A null id belongs to no
fold: such a row isn't held out, nor learned from. Repeated rows each get a row. Equal code lengths go to
the language first in alphabetical order. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm import ppm
from idloom.llm.common import in_fold, map_texts, pieces, small_batches, table, token, worker_state

ORDER = 4
#: Learned documents of each language, on average.
SAMPLE = 400
UNDETERMINED = "und"
_SEED, _RANGE = 71, 1 << 30


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", order: int = ORDER, sample: int = SAMPLE) -> tuple[list[str], list[ppm.Model]]:
    """Languages in alphabetical order and their models."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.filter(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    share = {r["l"]: min(1.0, sample / r["n"]) for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not share:
        return [], []
    limit = F.create_map(*[F.lit(x) for l, p in share.items() for x in (l, int(p * _RANGE))])
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(_SEED), F.col("i").cast("string")), F.lit(_RANGE)) < limit[F.col("l")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "t"):
            by: dict[str, list[bytes]] = {}
            for t, l in zip(piece.column("t").to_pylist(), piece.column("l").to_pylist(), strict=True):
                by.setdefault(l, []).append(t.encode())
            for l, texts in by.items():
                k, c = ppm.window_counts(texts, order)
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(k)), pa.array(k), pa.array(c)], names=["l", "k", "c"])

    counted = chosen.select("t", "l").mapInArrow(count, "l string, k long, c long").groupBy("l", "k").agg(F.sum("c").alias("c")).toArrow()
    names = sorted(share)
    name, key, value = np.asarray(counted["l"].to_pylist(), dtype=object), counted["k"].to_numpy(), counted["c"].to_numpy()
    models = []
    for l in names:
        own = name == l
        at = np.argsort(key[own], kind="stable")
        models.append(ppm.Model(ppm.levels_of(key[own][at], value[own][at], order)))
    return names, models


def predict(docs: DataFrame, names: list[str], models: list[ppm.Model], keep: list[str], text: str = "text", order: int = ORDER) -> DataFrame:
    """The columns to keep, lang_pred, score (the posterior of that language under equal priors) and
    bits_per_byte of the best language (null for und)."""
    spark = docs.sparkSession
    kept = docs.select(*keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    source = docs.select(*keep, F.when(has_letter(F.col(text)), F.col(text)).alias("__text"))
    shared = spark.sparkContext.broadcast(models)
    own = token()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("__text").to_pylist()
        some = [i for i, t in enumerate(texts) if t is not None] if names else []
        lang, score, per_byte = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [None] * len(texts)
        if some:
            scorer = worker_state(own, lambda: ppm.Scorer(shared.value, order))
            raw = [texts[i].encode() for i in some]
            bits = scorer.bits(raw)
            best = np.argmin(bits, axis=1)
            least = bits[np.arange(len(some)), best]
            p = 1.0 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(axis=1)
            for at, i in enumerate(some):
                lang[i], per_byte[i] = names[best[at]], float(least[at]) / (len(raw[at]) + 1)
            score[some] = p
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(per_byte, pa.float64())], names=[*keep, "lang_pred", "score", "bits_per_byte"])

    return map_texts(source, "__text", run, f"{fields}, lang_pred string, score double, bits_per_byte double")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = in_fold("doc_id", 3, 1)
    names, models = learn(docs, F.col("doc_id").isNotNull() & ~held)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), names, models, ["doc_id", "held_out"])


QUERIES = {"op1_language_id": op1}
SQL: dict[str, str] = {}
