import random

import numpy as np
import xxhash

from idloom.llm import simhash as s


def brute_fingerprint(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if x]
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=2):
    group = list(range(len(fps)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(r, n):
    out = set()
    centres = [r.getrandbits(64) for _ in range(8)]
    while len(out) < n:
        x = r.choice(centres) if r.random() < 0.7 else r.getrandbits(64)
        for _ in range(r.randrange(0, 7)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprint():
    for t in (None, "", " \t", "One", "one TWO", "a b c", "É é b", "a b c d " * 40, "x y" * 70000, "Σ\x00 b\x1c c d"):
        assert s.fingerprint(t) == brute_fingerprint(t), t and t[:20]


def test_tree_loses_no_link():
    r = random.Random(9)
    fps = clustered(r, 1500)
    points = np.array(fps, np.uint64)
    none = np.zeros(len(points), bool)
    tree, _ = s.grow(points[::3], none[::3], 40)
    shard, index, visits = s.route(tree, points, none)
    assert sorted(index[~visits]) == list(range(len(fps))) and len(set(shard)) > 10
    labels = np.arange(len(fps))
    for k in set(shard):
        own = np.flatnonzero(shard == k)
        root = s.forest(points[index[own]], visits[own])
        s.link(labels, index[own], index[own][root])
    assert labels.tolist() == brute_components(fps)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", rows[g].doc_id) for r, f, g in zip(rows, fps, brute_components(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in s.op7(spark, sf).collect()} == want


def signed(fps):
    return [int(np.uint64(f).view(np.int64)) for f in fps]


def test_many_near_copies(spark, monkeypatch):
    """With a small sample, so that shards are split again over several levels."""
    for k, v in {"SHARD": 48, "SAMPLE": 64, "FIT": 128, "ROUTED": 256}.items():
        monkeypatch.setattr(s, k, v)
    r = random.Random(11)
    fps = clustered(r, 1200)
    nodes = spark.createDataFrame([(f,) for f in signed(fps)], "fp long")
    got = {r.u: r.v for r in s.stars(s.links(nodes)).collect()}
    groups = {}
    for f, g in zip(signed(fps), brute_components(fps), strict=True):
        groups.setdefault(g, []).append(f)
    assert got == {f: min(g) for g in groups.values() for f in g if f != min(g)}


def test_largest_shard_is_bounded(spark):
    r = np.random.default_rng(4)
    for n in (20_000, 120_000):
        centres = r.integers(0, 1 << 63, 50, dtype=np.uint64)
        near = centres[r.integers(0, 50, n // 4)]
        for _ in range(5):
            near = near ^ (np.uint64(1) << r.integers(0, 64, n // 4).astype(np.uint64))
        fps = np.unique(np.concatenate((near, r.integers(0, 1 << 63, n - n // 4, dtype=np.uint64) * np.uint64(2))))
        places = s.shards(spark.createDataFrame([(f,) for f in fps.view(np.int64).tolist()], "fp long"))
        sizes = np.array([x.c for x in places.groupBy("shard").count().withColumnRenamed("count", "c").collect()])
        assert places.filter("not visits").count() == len(fps) and sizes.max() <= 4 * s.SHARD, (n, sizes.max(), np.median(sizes))


def test_nulls_repeats_and_empty_table(spark):
    schema = "doc_id long, text string, fp string, component_id int"
    rows = [(5, None, "", 0), (3, "", "", 0), (None, " ", "", 0), (9, "a b c d", "", 0), (9, "a b c d", "", 0), (None, "x y z", "", 0)]
    got = s.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 3), (3, 3), (5, 3), (9, 9), (9, 9)]
    assert s.near_duplicates(spark.createDataFrame([], schema)).collect() == []
