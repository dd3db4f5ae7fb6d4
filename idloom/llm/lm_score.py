"""Language-model scores by prediction by partial matching, beside a word model's.

The byte-context tree is learned from all documents that may be learned from: window counts are summed over the corpus, for each
order, and compiled with escapes and symbol exclusion (module ppm). No window is left out. The tree is never in one place: windows of
contexts of CUT symbols and more are dealt by the last CUT of them, so a shard has all that a code length depends on besides
the shorter orders, whose number the alphabet bounds. The code lengths of all windows that any text has, learned from or not, are computed
there in one pass; those of the most frequent, at most NODES, are broadcast, the others joined. What is modelled is the text's token sequence:
its lower-cased words with single spaces, closed by the end symbol; so texts that differ in white space only score alike, as
in the base.

Word counts (the base) are summed over all documents as well. Words frequent enough to fit a table of HOT words are
looked up where the texts are read; all others are joined, so no frequent word becomes a hot key and no table grows with the corpus.

`adaptive` scores a text by a tree that learns from the text itself as it goes, beginning empty.

Defined results: null texts count as empty and have one token, the end. Texts are scored whole. A null id is in no fold: such
a row isn't held out, nor learned from. Rows repeat as in the input. With nothing to learn from every count is zero, the
base is zero and all symbols are equally likely. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm import ppm
from idloom.llm.common import give_back, in_fold, map_texts, pieces, small_batches, table, token, worker_state, written

ORDER = 6
#: Windows and words in the tables that are broadcast, at most.
NODES, HOT = 2_000_000, 200_000
#: Symbols of a context that windows are dealt by, and windows that a shard should have.
CUT, SHARD = 3, 200_000
#: Words and windows that a counting task holds before it passes them on.
HELD_WORDS, HELD_WINDOWS = 400_000, 3_000_000
END = b""  # no word is empty
SMALL = 0.1


def words_of(text: str | None) -> list[bytes]:
    """Bytes split at the six ASCII white spaces, with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def counts(docs: DataFrame, text: str, order: int = ORDER, learned: Column | None = None) -> DataFrame:
    """word, gram, n: how often each word (the end: empty) and each window occurs in the documents learned from; one of the two keys is
    null. Windows of other documents count as zero."""
    small_batches(docs.sparkSession)

    def flush(words: Counter, grams: list) -> Iterator[pa.RecordBatch]:
        k, c = ppm.merge_counts(grams) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        names = list(words)
        for at in range(0, len(names), 1 << 16):
            part = names[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.nulls(len(part), pa.int64()), pa.array([words[w] for w in part], pa.int64())], names=["word", "gram", "n"])
        for at in range(0, len(k), 1 << 16):
            part = k[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(c[at : at + (1 << 16)])], names=["word", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, held = Counter(), [], 0
        for piece in pieces(batches, "t"):
            split: dict[bool, list[list[bytes]]] = {True: [], False: []}
            for t, own in zip(piece.column("t").to_pylist(), piece.column("l").to_pylist(), strict=True):
                split[own].append(words_of(t))
            for w in split[True]:
                words.update(w)
            words[END] += len(split[True])
            for own, texts in split.items():
                k, c = ppm.window_counts([b" ".join(w) for w in texts], order)
                grams.append((k, c if own else np.zeros_like(c)))
                held += len(k)
            if held > HELD_WINDOWS:
                grams = [ppm.merge_counts(grams)]
                held = len(grams[0][0])
            if len(words) > HELD_WORDS or held > HELD_WINDOWS:
                yield from flush(+words, grams)
                words, grams, held = Counter(), [], 0
        yield from flush(+words, grams)
        words, grams = None, None
        give_back()

    flag = F.lit(True) if learned is None else F.coalesce(learned, F.lit(False))
    return docs.select(F.col(text).alias("t"), flag.alias("l")).mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def least_count(rows: DataFrame, most: int) -> int:
    """The smallest power of two such that at most `most` rows have n of that size."""
    sizes = {r["b"]: r["c"] for r in rows.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("c")).collect()}
    total, b = 0, max(sizes, default=0)
    while b >= 0 and total + sizes.get(b, 0) <= most:
        total += sizes.get(b, 0)
        b -= 1
    return 1 << (b + 1)


def levels(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """j, gram, k: all windows of the orders 0 to `order`, and what the tree counts."""
    out = grams.select(F.lit(order).alias("j"), "gram", F.col("n").alias("k"))
    for j in range(order - 1, -1, -1):
        grams = written(grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << ppm.BITS * (j + 1)) - 1)).alias("gram")).agg(F.count("*").alias("k")))
        out = out.union(grams.select(F.lit(j).alias("j"), "gram", "k"))
    return out


def _sorted(t: pa.Table, j: int) -> tuple[np.ndarray, np.ndarray]:
    own = t["j"].to_numpy() == j
    key, k = t["gram"].to_numpy()[own], t["k"].to_numpy()[own]
    at = np.argsort(key, kind="stable")
    return key[at], k[at]


def code_lengths(every: DataFrame, asked: DataFrame, order: int, shard: int = SHARD) -> DataFrame:
    """gram, n, bits: the distinct windows asked for (gram, n) and their code lengths under the tree of all windows j, gram, k."""
    cut = min(CUT, order + 1)
    low = every.filter(F.col("j") < cut).toArrow()
    shared = every.sparkSession.sparkContext.broadcast([_sorted(low, j) for j in range(cut)])
    long = every.filter(F.col("j") >= cut)
    shards = max(1, -(-(long.count() + asked.count()) // shard))

    def search(t: pa.Table) -> pa.Table:
        model = ppm.Model([*shared.value, *(_sorted(t, j) for j in range(cut, order + 1))])
        gram, n = _sorted(t, -1)
        return pa.table({"gram": gram, "n": n, "bits": model.bits(gram)})

    both = long.union(asked.select(F.lit(-1).alias("j"), "gram", F.col("n").alias("k")))
    context = F.shiftright("gram", ppm.BITS).bitwiseAND(F.lit((1 << ppm.BITS * cut) - 1))
    return both.withColumn("shard", F.pmod(F.xxhash64(context), F.lit(shards))).groupBy("shard").applyInArrow(search, "gram long, n long, bits double")


class Frequent:
    """Code lengths of the windows of a table, NaN for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def bits(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), np.nan)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.values[i], np.nan)


def known_bits(scorer: ppm.Scorer, texts: list[bytes], block: int = 1 << 18) -> tuple[np.ndarray, pa.ListArray]:
    """For each text the code length of its windows in the table, and its other windows."""
    out, others, texts_of = np.zeros(len(texts)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    keys, starts, ends = ppm.windows(texts, scorer.order)
    for at in range(0, len(keys), block):
        own = np.ascontiguousarray(keys[at : at + block])
        part = np.append(scorer.window_bits(own)[:, 0], 0.0)
        i = np.flatnonzero(np.isnan(part))
        part[i] = 0.0
        t = np.searchsorted(starts, i + at, "right") - 1
        inside = i + at < ends[t]
        others.append(own[i[inside]])
        texts_of.append(t[inside])
        a, b = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + block, "left")
        if a < b:
            edges = np.stack((np.maximum(starts[a:b] - at, 0), np.minimum(ends[a:b] - at, len(part) - 1)), axis=1).ravel()
            out[a:b] += np.add.reduceat(part, edges)[::2]
    sizes = np.bincount(np.concatenate(texts_of), minlength=len(texts))
    return out, pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(np.concatenate(others)))


def adaptive(text: str | None, order: int = 3) -> float:
    """log10 of the probability of a text under a tree that starts empty and learns each symbol after coding it.
    Works on the text's own contexts only, so its memory follows that text."""
    symbols = [ppm.START] * order + list(b" ".join(words_of(text))) + [ppm.END]
    seen: dict[tuple, Counter] = {}
    bits = 0.0
    for i in range(order, len(symbols)):
        out: set[int] = set()
        s, found = symbols[i], False
        for j in range(order, -1, -1):
            at = seen.get(tuple(symbols[i - j : i]))
            if not at:
                continue
            left = {k: v for k, v in at.items() if k not in out} if out else at
            n, d = sum(left.values()), len(left)
            if s in left:
                bits -= math.log2((2 * left[s] - 1) / (2 * n))
                found = True
                break
            if d:
                bits -= math.log2(d / (2 * n))
            out |= set(at)
        if not found:
            bits += math.log2(ppm.SYMBOLS - len(out))
        for j in range(order + 1):
            seen.setdefault(tuple(symbols[i - j : i]), Counter())[s] += 1
    return -bits * math.log10(2)


def scored(docs: DataFrame, may_learn: Column, keep: list[str], text: str = "text", order: int = ORDER, hot: int = HOT, nodes: int = NODES) -> DataFrame:
    """The columns to keep, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    table_ = written(counts(docs, text, order, may_learn))
    words = table_.filter("word is not null").select("word", "n")
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least = least_count(words, hot)
    frequent = words.filter(F.col("n") >= least).toArrow()
    known = dict(zip(frequent["word"].to_pylist(), np.log10(frequent["n"].to_numpy() + SMALL).tolist(), strict=True))
    grams = table_.filter("gram is not null").select("gram", "n")
    learned = grams.filter("n > 0")
    lengths = written(code_lengths(levels(learned, order), grams, order))
    often = F.col("n") >= max(1, least_count(learned, nodes))
    top = lengths.filter(often).select("gram", "bits").toArrow()
    at = np.argsort(keys := top["gram"].to_numpy(), kind="stable")
    shared = spark.sparkContext.broadcast((known, keys[at], top["bits"].to_numpy()[at]))
    own = token()
    names = [f"k{i}" for i in range(len(keep))]  # whatever their own names are
    fields = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, docs.select(*keep).schema.fields, strict=True))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, scorer = worker_state(own, lambda: (shared.value[0], ppm.Scorer([Frequent(*shared.value[1:])], order, slots=21)))
        split = [words_of(t) for t in batch.column("t").to_pylist()]
        bits, windows = known_bits(scorer, [b" ".join(w) for w in split])
        n, sums, hits, rare, at = [], [], [], [], [0]
        for w in split:
            w.append(END)
            found = [v for v in map(known.get, w) if v is not None]
            if len(found) < len(w):
                rare += [x for x in w if x not in known]
            at.append(len(rare))
            n.append(len(w))
            hits.append(len(found))
            sums.append(math.fsum(found))
        rest = pa.ListArray.from_arrays(np.array(at, np.int32), pa.array(rare, pa.binary()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(sums, pa.float64()), pa.array(bits), rest, windows], names=[*names, "n_tokens", "hits", "sums", "own_bits", "rare", "windows"])

    # ids are given once and written with the rows
    source = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("t"))
    rows = written(map_texts(source, "t", run, f"{fields}n_tokens long, hits long, sums double, own_bits double, rare array<binary>, windows array<long>").withColumn("rid", F.monotonically_increasing_id()))
    others = rows.select("rid", F.explode("rare").alias("word")).join(words.filter(F.col("n") < least), "word", "left")
    rest = others.groupBy("rid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + SMALL)).alias("s"), F.count("n").alias("k"))
    asked = rows.select("rid", F.explode("windows").alias("gram"))
    more = asked.join(lengths.filter(~often).select("gram", "bits"), "gram").groupBy("rid").agg(F.sum("bits").alias("more_bits"))
    floor = math.log10(whole["n"] + SMALL * (whole["v"] + 1))
    return rows.join(rest, "rid", "left").join(more, "rid", "left").select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        "n_tokens",
        (F.col("hits") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(whole["n"]).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("s", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        (-(F.col("own_bits") + F.coalesce("more_bits", F.lit(0.0))) * math.log10(2)).alias("score"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    held = in_fold("doc_id", 10, 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    return scored(docs, F.col("doc_id").isNotNull() & ~F.col("held_out"), ["doc_id", "held_out"])


QUERIES = {"op3_lm_score": op3}
SQL: dict[str, str] = {}
