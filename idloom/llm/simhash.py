"""SimHash near-duplicates by a vantage-point tree over fingerprints.

Distinct fingerprints are routed through a tree: at a node, those within `m` bits of the vantage point go inside, the others outside, and
an inner one that may have a partner outside, by the triangle inequality, also visits the outside. So every linked pair meets in
exactly one shard. The first tree is fitted on a bounded sample; shards that hold too many points, visits counted, get a tree of their own,
fitted on a sample of theirs, and are routed again in tasks of bounded size, level by level, until none is too large or can be split. A shard
splits its own points in the same way, compares what is left bit by bit, and returns a spanning forest of its links, never the
pairs of a group. Components of these forests come from star contractions over tables in the shared folder. Copies are one
fingerprint throughout and meet their document rows in one equi-join, which Spark may split where a fingerprint is hot.

With a similarity asked for, pairs that the tree links are compared by their sets of shingles, and module jaccard completes them with those pairs
that are similar although their fingerprints are further apart; links are then exact by similarity.

Defined results: null and empty texts, and those without words, have fingerprint zero and are linked like any
other (by similarity: their one shingle is empty). Texts of fewer words than a shingle have one shingle, all their words.
component_id is the smallest non-null id reachable; null only if all ids of a component are null. Rows
repeat as in the input; further columns are ignored. Very long texts are hashed whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm import jaccard
from idloom.llm.common import map_texts, table, written
from idloom.llm.components import least, stars

WORDS, SEED, RADIUS = 3, 42, 2
#: Fingerprints that the first tree is fitted on, and that of a shard, on average; and those that a shard should have, visits counted.
SAMPLE, FIT, SHARD = 16_384, 4096, 4096
#: Points that one task routes.
ROUTED = 1 << 16
#: Points that are compared directly.
DIRECT = 192
#: What a split costs besides copies, as a share of the points; the largest share that one side of a split may have, and that of both together.
EACH, MOST, COPIES = 0.005, 0.995, 1.5
_BLOCK, _RANGE = 1 << 16, 1 << 30


def fingerprint(text: str | None, words: int = WORDS) -> int:
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = (b" ".join(s) for s in zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else iter((b" ".join(w),))
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        size = min(_BLOCK, n - at)
        h = np.fromiter((digest(s, SEED) for _, s in zip(range(size), shingles, strict=False)), np.uint64, size)
        ones += set_bits(h)
    return majority(ones, n)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """The columns to keep and fp (the fingerprint as a signed long)."""
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(t, words) for t in batch.column("__text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(got.view(np.int64))], names=[*keep, "fp"])

    return map_texts(docs.select(*keep, F.col(text).alias("__text")), "__text", run, f"{fields}fp long")


def bits(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def vantage(own: np.ndarray, visits: np.ndarray, radius: int, seed: int) -> tuple[np.uint64, int] | None:
    """The vantage point and distance of the split that parts the points, visits counted, with the fewest copies for what it tells them
    apart; None if all splits copy too many or leave nearly all on one side."""
    best, found, n, m = np.inf, None, len(own) + len(visits), np.arange(65)
    low, high = np.maximum(m - radius + 1, 0), np.minimum(m + radius + 1, 65)
    for v in own[np.random.default_rng(seed).permutation(len(own))[:12]]:
        mine, others = (np.concatenate(([0], np.cumsum(np.bincount(bits(x, v), minlength=65)))) for x in (own, visits))
        inside, outside = mine[m + 1] + others[high], n - mine[low] - others[low]
        share = inside / (inside + outside)
        with np.errstate(divide="ignore", invalid="ignore"):
            told = -share * np.log(share) - (1 - share) * np.log(1 - share)
            cost = ((inside + outside - n) / n + EACH) / told
        cost[(mine[m + 1] == 0) | (mine[m + 1] == len(own)) | (np.maximum(inside, outside) > MOST * n) | (inside + outside > COPIES * n)] = np.inf
        at = int(cost.argmin())
        if cost[at] < best:
            best, found = cost[at], (v, at)
    return found


def divided(own: np.ndarray, visits: np.ndarray, to: tuple, split: tuple, radius: int) -> tuple[tuple, tuple]:
    """Own points and visits, given by index into `to`, inside and outside."""
    (v, m), points = split, to
    d, e = bits(points[own], v), bits(points[visits], v)
    return (own[d <= m], visits[e - radius <= m]), (own[d > m], np.concatenate((own[(d <= m) & (d + radius > m)], visits[e + radius > m])))


def grow(points: np.ndarray, visits: np.ndarray, target: int, radius: int = RADIUS) -> tuple[list[tuple], list[int]]:
    """The routing tree as rows (vantage point, m, inside, outside); a child below zero is shard -1 - child. Then the shards that are too large
    but that no split parts. visits: which points don't belong; target: points of a shard, visits counted."""
    nodes: list[list] = []
    shards, whole = 0, []

    def build(own: np.ndarray, seen: np.ndarray) -> int:
        nonlocal shards
        large = len(own) + len(seen) > target
        split = vantage(points[own], points[seen], radius, len(nodes)) if large and len(own) > 1 else None
        if split is None:
            if large:
                whole.append(shards)
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append([*split, 0, 0])
        nodes[at][2:] = [build(*part) for part in divided(own, seen, points, split, radius)]
        return at

    build(np.flatnonzero(~visits), np.flatnonzero(visits))
    return [tuple(n) for n in nodes], whole


def route(tree: list[tuple], points: np.ndarray, visits: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, point's index and whether it visits, for every place that a point goes to."""
    out = []
    work = [(0 if tree else -1, np.flatnonzero(~visits), np.flatnonzero(visits))]
    while work:
        at, own, seen = work.pop()
        if not len(own) + len(seen):
            continue
        if at < 0:
            out += [(np.full(len(i), -1 - at), i, np.full(len(i), who)) for i, who in ((own, False), (seen, True))]
            continue
        v, m, *children = tree[at]
        work += [(child, *part) for child, part in zip(children, divided(own, seen, points, (v, m), radius), strict=True)]
    shard, index, who = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
    return shard, index, who.astype(bool)


def link(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the labels of a and b; every label is the smallest index of its group."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def forest(points: np.ndarray, visits: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For every point the smallest index that it is linked to, over links with at least one point that
    doesn't visit."""
    labels = np.arange(len(points))
    work = [(np.flatnonzero(~visits), np.flatnonzero(visits))]
    while work:
        own, seen = work.pop()
        if not len(own):
            continue
        split = vantage(points[own], points[seen], radius, len(own)) if len(own) > DIRECT else None
        if split is not None:
            work += divided(own, seen, points, split, radius)
            continue
        every = np.concatenate((own, seen))
        for at in range(0, len(own), DIRECT):
            for to in range(at, len(every), 1 << 14):
                i, j = np.nonzero(np.bitwise_count(points[own[at : at + DIRECT], None] ^ points[None, every[to : to + (1 << 14)]]) <= radius)
                link(labels, own[at + i], every[to + j])
    return labels


_PLACE = "shard long, fp long, visits boolean, whole boolean"


def _places(shard: np.ndarray, fp: np.ndarray, who: np.ndarray, whole: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(fp), pa.array(who), pa.array(np.isin(shard, whole))], names=["shard", "fp", "visits", "whole"])


def _first_level(nodes: DataFrame, radius: int) -> DataFrame:
    spark = nodes.sparkSession
    n = nodes.count()
    picked = nodes.filter(F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(_RANGE)) < int(_RANGE * min(1, SAMPLE / max(1, n)))).select("fp").toArrow()["fp"].to_numpy().view(np.uint64)
    scale = n / max(1, len(picked))
    tree, _ = grow(np.sort(picked), np.zeros(len(picked), bool), max(16, int(SHARD / max(1.0, scale))), radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in chain(batches, [None]):  # None: no more come
            if b is not None:
                held.append(b.column("fp").to_numpy())
                rows += len(held[-1])
            if rows >= ROUTED or b is None and rows:
                fp = np.concatenate(held)
                held, rows = [], 0
                shard, index, who = route(tree, fp.view(np.uint64), np.zeros(len(fp), bool), radius)
                yield _places(shard, fp[index], who, [])

    return nodes.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(deal, _PLACE)


def _next_level(large: DataFrame, level: int, radius: int) -> DataFrame:
    """The shards (with c, their sizes) dealt anew. What a sample of a shard's own can't part stays whole."""
    kinds = (np.int64, np.uint64, np.int64, np.int64, np.int64)

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        points, visits, c = t["fp"].to_numpy().view(np.uint64), t["visits"].to_numpy(), t["c"][0].as_py()
        at = np.argsort(points, kind="stable")
        rows, whole = grow(points[at], visits[at], max(16, int(SHARD / max(1.0, c / len(points)))), radius)
        every = [(i, *row) for i, row in enumerate(rows)] + [(-1 - i, 0, 0, 0, 0) for i in whole]  # below zero: a shard that stays
        at, v, m, inside, outside = (np.array(x, k) for x, k in zip(zip(*every, strict=True), kinds, strict=True)) if every else (np.zeros(0, k) for k in kinds)
        return pa.table({"shard": pa.array([key[0].as_py()] * len(every), pa.int64()), "at": at, "v": v.view(np.int64), "m": m, "inside": inside, "outside": outside})

    def again(key: tuple, t: pa.Table, tree: pa.Table) -> pa.Table:
        tree = tree.sort_by("at")
        at = tree["at"].to_numpy()
        rows = list(zip(tree["v"].to_numpy().view(np.uint64)[at >= 0], *(tree[c].to_numpy()[at >= 0].tolist() for c in ("m", "inside", "outside")), strict=True))
        fp = t["fp"].to_numpy()
        shard, index, who = route(rows, fp.view(np.uint64), t["visits"].to_numpy(), radius)
        return pa.Table.from_batches([_places(shard, fp[index], who, (-1 - at[at < 0]).tolist())]).append_column("of", pa.array([key[0].as_py()] * len(shard), pa.int64()))

    sample = large.filter(F.pmod(F.xxhash64(F.lit(level), "fp"), F.lit(_RANGE)) < F.lit(_RANGE) * F.least(F.lit(1.0), FIT / F.col("c")))
    trees = written(sample.groupBy("shard").applyInArrow(fit, "shard long, at long, v long, m long, inside long, outside long"))
    tasks = F.ceil(F.col("c") / ROUTED)
    known = large.withColumn("part", F.pmod(F.xxhash64("fp"), tasks))
    parts = trees.join(large.select("shard", tasks.alias("k")).distinct(), "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = known.groupBy("shard", "part").cogroup(parts.groupBy("shard", "part")).applyInArrow(again, f"{_PLACE}, of long")
    # shards of equal hashes would be one, which loses nothing
    return dealt.select(F.xxhash64("of", "shard").alias("shard"), "fp", "visits", "whole")


def shards(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """shard, fp, visits: the places of all fingerprints. A shard of more than twice SHARD is one that no split parts."""
    out, dealt, level = None, written(_first_level(nodes, radius)), 0
    while True:
        level += 1
        sizes = written(dealt.filter("not whole").groupBy("shard").agg(F.count("*").alias("c")).filter(F.col("c") > 2 * SHARD))
        if sizes.isEmpty():
            return (dealt if out is None else out.union(dealt)).select("shard", "fp", "visits")
        small = dealt.join(sizes, "shard", "left_anti")
        out = small if out is None else out.union(small)
        dealt = written(_next_level(dealt.join(sizes, "shard"), level, radius))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: edges that connect what is linked among the distinct fingerprints `fp` of nodes."""

    def search(t: pa.Table) -> pa.Table:
        fp = t["fp"].to_numpy()
        at = np.argsort(fp, kind="stable")
        fp, visits = fp[at], t["visits"].to_numpy()[at]
        root = forest(fp.view(np.uint64), visits, radius)
        some = root != np.arange(len(fp))
        return pa.table({"u": fp[some], "v": fp[root[some]]})

    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards(nodes, radius).repartition(partitions, "shard").groupBy("shard").applyInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row."""
    rows = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), ["doc_id"], "t", words))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = least(stars(links(nodes, radius)), nodes, "fp")
    return rows.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _sets(docs: DataFrame, often: np.ndarray, words: int) -> DataFrame:
    """doc_id, th (hash of the text), node, n (number of shingles), some (of these, how many are asked for first), fp and hot (shingles that
    are often met) of every row."""
    kind, shared = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(often)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, n, some, fp, hot, ends = [], [], [], [], [], [0]
        for t in batch.column("t").to_pylist():
            every = jaccard.shingles(w := t.encode().lower().split() if t else [], words)
            own = np.unique(every).view(np.int64)
            met = jaccard.inside(shared.value, own)
            node.append(jaccard.node(own))
            n.append(len(own))
            some.append(int((jaccard.first(own) & ~met).sum()))
            fp.append(majority(set_bits(every), len(every)) if w else 0)
            hot.append(own[met])
            ends.append(ends[-1] + len(hot[-1]))
        lists = pa.ListArray.from_arrays(np.array(ends, np.int32), pa.array(np.concatenate(hot)))
        numbers = [pa.array(x, pa.int64()) for x in (node, n, some)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *numbers, pa.array(np.array(fp, np.uint64).view(np.int64)), lists], names=["doc_id", "th", "node", "n", "some", "fp", "hot"])

    return map_texts(docs, "t", run, f"doc_id {kind}, th long, node long, n long, some long, fp long, hot array<long>")


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = jaccard.WORDS) -> DataFrame:
    """doc_id, component_id for every row: components of texts whose sets of shingles have a Jaccard similarity of 4 / 5 or more."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    often = jaccard.hot(docs, "t", words)
    rows = written(_sets(docs, often, words))
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "some", "fp", "hot")], F.min("th").alias("th")))
    lead = written(nodes.groupBy("fp").agg(F.min("node").alias("with")))
    same = nodes.join(lead, "fp").filter(F.col("node") != F.col("with")).select("node", "with")
    of = lambda end, name: lead.select(F.col("fp").alias(end), F.col("with").alias(name))
    tree = links(lead, radius).join(of("u", "node"), "u").join(of("v", "with"), "v").select("node", "with")
    star = jaccard.links(docs, nodes, same.union(tree), words, often)
    return rows.select("doc_id", "node").join(least(star, nodes, "node"), "node").select("doc_id", "component_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_simhash": op7}
SQL: dict[str, str] = {}
