"""Links between sets of shingles of an exact Jaccard similarity, 4 / 5 or more: what module simhash asks for where fingerprints
a few bits apart aren't enough.

A node is a distinct set of 64-bit shingle hashes. All shingles have one order, the rarest first; in it, linked sets of n and m
shingles share one at places i and j such that n - i and m - j are both at least 4 (n + m) / 9 (prefix filter with
positions). So a shingle of a set stands in the shingle's list with the largest partner that it can still announce, and lists are
joined with themselves under these bounds. Shingles of one node alone come first in the order and are dropped.

Most texts are like no other, and more than a fifth of their shingles are theirs alone, so they can't be linked. To find that out two in
five shingles, chosen by their hash, are enough: only nodes that have no more than a fifth of all their shingles alone among these
are looked at any further, now with all shingles, counted among such nodes.

Candidates are compared in rounds: first every node with the most central member (that with the fewest shingles of its own) of
its lists, which joins most groups of near copies at once; then a growing share of each list's members, chosen by a
hash, meet all others of the list that aren't in their component yet, and leave it. Lists whose nodes aren't linked cost up to their
square; no candidate is left out.

Shingles that many documents of a sample share (`hot`, a bounded number) come last in the order and are never counted or
sorted by, so no list or group of theirs is a hot key. The sample decides on the order only: results don't depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idloom.llm.common import map_texts, written
from idloom.llm.components import stars

#: The similarity, as a fraction.
A, B = 4, 5
WORDS = 5
#: Documents that are looked at for hot shingles, on average; documents of these that a hot one is in; and how many there may be.
SAMPLE, OFTEN, MOST = 2048, 6, 100_000
SEED = 42
#: Nodes whose hashes may be broadcast.
FEW = 1 << 20
_RANGE = 1 << 30


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all shingles, in order and with repeats; at least one, of all words if they are fewer."""
    digest = xxhash.xxh64_intdigest
    parts = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else (b" ".join(words),)
    return np.fromiter((digest(p, SEED) for p in parts), np.uint64)


def of_text(text: str | None, size: int) -> np.ndarray:
    """The set of a text: sorted and distinct."""
    return np.unique(shingles(text.encode().lower().split() if text else [], size)).view(np.int64)


def node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def inside(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def hot(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Shingles that at least OFTEN documents of a sample have, at most MOST."""
    picked = docs.select(F.coalesce(text, F.lit("")).alias("t")).filter(F.pmod(F.xxhash64(F.lit(17), "t"), F.lit(_RANGE)) < int(_RANGE * min(1, SAMPLE / max(1, docs.count()))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(list({node(s): s for s in (of_text(t, size) for t in batch.column("t").to_pylist())}.values())), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], names=["h", "c"])

    found = map_texts(picked, "t", run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= OFTEN)
    return np.sort(found.orderBy(F.desc("c"), "h").limit(MOST).select("h").toArrow()["h"].to_numpy())


def first(hashes: np.ndarray) -> np.ndarray:
    """Which shingles are asked for first."""
    return hashes.view(np.uint64) % np.uint64(5) < 2


def shared(docs: DataFrame, size: int, often: np.ndarray, some: bool) -> DataFrame:
    """node, h and df (in how many texts, copies of a task told once) of the shingles that several nodes have, without hot ones. some: only
    those that are asked for first."""
    hot_ = docs.sparkSession.sparkContext.broadcast(often)
    met: set[int] = set()  # of a task: copies are told once

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(met) > 1 << 20:
            met.clear()
        for t in batch.column("t").to_pylist():
            s = of_text(t, size)
            if (n := node(s)) not in met:
                met.add(n)
                s = s[~inside(hot_.value, s) & (first(s) if some else True)]
                nodes.append(np.full(len(s), n))
                hashes.append(s)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(hashes))], names=["node", "h"])

    own = Window.partitionBy("h")
    found = map_texts(docs.select("t"), "t", run, "node long, h long")
    return found.select("node", "h", F.count("*").over(own).alias("df"), F.min("node").over(own).alias("a"), F.max("node").over(own).alias("b")).filter("a <> b").select("node", "h", "df")


def sets(docs: DataFrame, nodes: DataFrame, size: int, often: np.ndarray) -> DataFrame:
    """node, n and toks (the shingles that other nodes have as well, the rarest first) of the nodes that may have a link. docs: th, t; nodes:
    node, th, n, some, hot."""
    of_some = shared(docs, size, often, True).groupBy("node").agg(F.countDistinct("h").alias("c"))
    alone = F.col("some") - F.coalesce("c", F.lit(0))
    may = written(nodes.join(of_some, "node", "left").filter(B * alone <= (B - A) * F.col("n")).select("node", "th", "n", "hot"))
    # texts are shuffled only where there are too many to be broadcast
    keys = may.select("th")
    texts = docs.join(F.broadcast(keys) if may.count() <= FEW else keys, "th", "left_semi")
    toks = shared(texts, size, often, False).groupBy("node").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("s"))
    every = F.concat(F.coalesce("s.h", F.array().cast("array<bigint>")), "hot")
    return written(may.join(toks, "node", "left").select("node", "n", every.alias("toks")).filter(B * F.size("toks") >= A * F.col("n")))


def linked(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """u, v: the pairs `node`, `with` whose sets are similar. full: node, n and all shingles that others have as well."""
    one = full.select("node", "n", "toks")
    both = pairs.join(one, "node").join(one.select(F.col("node").alias("with"), F.col("n").alias("m"), F.col("toks").alias("others")), "with")
    return both.filter((A + B) * F.size(F.array_intersect("toks", "others")) >= A * (F.col("n") + F.col("m"))).select(F.col("node").alias("u"), F.col("with").alias("v"))


def entries(full: DataFrame) -> DataFrame:
    """h, node, n, most (shingles of the largest partner) and alone (shingles of its own) for each shingle that can announce a partner."""
    places = full.withColumn("p", F.floor((B * F.size("toks") - A * F.col("n")) / B).cast("int") + 1).filter("p > 0")
    rows = places.select("node", "n", F.size("toks").alias("m"), F.posexplode(F.slice("toks", F.lit(1), F.col("p"))).alias("k", "h"))
    return rows.select("h", "node", "n", (F.floor((A + B) * (F.col("m") - F.col("k")) / A) - F.col("n")).alias("most"), ((F.col("n") - F.col("m")) / F.col("n")).alias("alone"))


def links(docs: DataFrame, nodes: DataFrame, near: DataFrame, size: int, often: np.ndarray) -> DataFrame:
    """u, v with v the smallest node of u's component, for every u that isn't that itself. docs and nodes: as for `sets`; near: pairs node,
    with that are worth comparing first."""
    full = sets(docs, nodes, size, often)
    may = (F.col("node") != F.col("q.node")) & (F.col("n") <= F.col("q.most")) & (F.col("q.n") <= F.col("most"))

    every = entries(full)
    alive = every.groupBy("h").agg(F.count("*").alias("c"), F.min(F.struct("alone", "node", "n", "most")).alias("q")).filter("c > 1")
    every = written(every.join(alive, "h"))
    central = every.filter(may).groupBy("node").agg(F.min("q").alias("q")).select("node", F.col("q.node").alias("with"))
    label = stars(linked(near.union(central).distinct(), full))
    rest, share = every.drop("c", "q"), 1
    while True:
        rooted = rest.join(label.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
        lists = rooted.groupBy("h").agg(F.count("*").alias("c"), F.min("root").alias("a"), F.max("root").alias("b"), F.min("n").alias("low"), F.max("most").alias("high")).filter("a <> b")
        live = written(rooted.join(lists, "h").filter("most >= low and n <= high").select("h", "node", "n", "most", "root", "c"))
        size, pairs = live.agg(F.count("*"), F.sum((F.col("c") - 1) / 2)).first()
        if not size:
            return label
        last = pairs <= 4 * size
        leads = live.withColumn("lead", F.lit(True) if last else F.pmod(F.xxhash64(F.lit(share), "node"), F.ceil(F.col("c") / share)) == 0)
        q = leads.filter("lead").select("h", F.struct("node", "n", "most", "root").alias("q"))
        met = leads.join(q, "h").filter(may & (F.col("root") != F.col("q.root")) & (~F.col("lead") | (F.col("node") < F.col("q.node")))).select("node", F.col("q.node").alias("with")).distinct()
        new = written(linked(met, full))
        if not new.isEmpty():
            label = stars(label.union(new))
        if last:
            return label
        rest, share = written(leads.filter("not lead").select("h", "node", "n", "most")), share * 4
