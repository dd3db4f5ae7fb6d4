import math
import random

import numpy as np
from pyspark.sql import functions as F

from idloom.llm import toxicity as t

SCHEMA = "doc_id long, text string, score string, toxic int"


def corpus(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choices(["ka", "mo", "ti", "ser", "lu"], k=r.randrange(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = r.choices(words, k=r.randrange(5, 120))
        if i % 4 == 0:
            w[r.randrange(len(w))] = r.choice(["vile", "nasty", "vile"])
        rows.append((i, " ".join(w), "", int(i % 4 == 0)))
    return rows


def test_gradients():
    r = np.random.default_rng(3)
    net = t.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows = np.array([[0, 1, 2, 1], [2, 0, -1, -1], [1, -1, -1, -1]])
    x, weight = r.normal(size=(3, t.WORD + t.CHAR)), r.normal(size=3)
    loss = lambda: float((net.forward(net.projected(x), rows).astype(np.float64) * weight).sum())
    keep = []
    net.forward(net.projected(x), rows, keep)
    g, dx = net.backward(weight, keep, rows, 3)
    g["w"], g["b"] = np.matmul(x.T[None], dx), dx.sum(axis=1, keepdims=True)
    for name in ("w", "b", "u", "wa", "ba", "va", "wo", "bo"):
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in net.p[name].shape)
            old, e = net.p[name][at], 1e-2
            net.p[name][at] = old + e
            up = loss()
            net.p[name][at] = old - e
            slope = (up - loss()) / (2 * e)
            net.p[name][at] = old
            assert abs(slope - g[name][at]) < 2e-3 + 0.02 * abs(slope), (name, slope, g[name][at])


def plain_score(net, text):
    """The highest window's probability, by loops over words, gates and units."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    sigma = lambda x: 1 / (1 + math.exp(-x))

    def vector(word):
        rows, _ = t.gram_rows([word])
        return [*p["word"][net.vocabulary.get(word, 0)], *p["char"][rows].mean(axis=0)]

    def states(window, k):
        h, out = [0.0] * t.STATE, []
        for x in window:
            a = [sum(x[i] * p["w"][k][i][j] for i in range(len(x))) + p["b"][k][0][j] for j in range(3 * t.STATE)]
            g = [sum(h[i] * p["u"][k][i][j] for i in range(t.STATE)) for j in range(3 * t.STATE)]
            new = []
            for j in range(t.STATE):
                z, reset = sigma(a[j] + g[j]), sigma(a[t.STATE + j] + g[t.STATE + j])
                c = math.tanh(a[2 * t.STATE + j] + reset * g[2 * t.STATE + j])
                new.append(z * h[j] + (1 - z) * c)
            h = new
            out.append(h)
        return out

    words = t.words_of(text)
    best = 0.0
    for start in t.window_starts(len(words)):
        x = [vector(w) for w in words[start : start + t.WINDOW]]
        both = [a + b for a, b in zip(states(x, 0), states(x[::-1], 1)[::-1], strict=True)]
        energy = [sum(math.tanh(sum(s[i] * p["wa"][i][j] for i in range(len(s))) + p["ba"][j]) * p["va"][j] for j in range(t.ATTENTION)) for s in both]
        weight = [math.exp(e - max(energy)) for e in energy]
        pooled = [sum(w * s[i] for w, s in zip(weight, both, strict=True)) / sum(weight) for i in range(2 * t.STATE)]
        best = max(best, sigma(sum(a * b for a, b in zip(pooled, p["wo"], strict=True)) + p["bo"][0]))
    return best


def test_scores_against_plain_loops():
    net = t.train([r[1] for r in corpus(60)], [r[3] for r in corpus(60)])
    texts = [r[1] for r in corpus(6, seed=5)] + ["vile", "Ka, MO ti!", "neu word " * 40]
    assert np.allclose(t.Scorer(net).scores(texts), [plain_score(net, x) for x in texts], atol=1e-4)


def test_windows_cover_and_overlap():
    for n in range(0, 300):
        starts = t.window_starts(n)
        seen = {i for a in starts for i in range(a, min(n, a + t.WINDOW))}
        assert seen == set(range(n)) and all(b - a < t.WINDOW for a, b in zip(starts, starts[1:], strict=False))


def test_learns_and_scores_alike_in_any_batch(spark):
    rows = corpus(600)
    net = t.train([r[1] for r in rows[:400]], [r[3] for r in rows[:400]])
    held = [r[1] for r in rows[400:]]
    whole = t.Scorer(net).scores(held)
    assert np.allclose(whole, np.concatenate([t.Scorer(net).scores([x]) for x in held]), atol=1e-5)
    assert ((whole >= 0.7) == [r[3] for r in rows[400:]]).mean() > 0.95


def test_documents_nulls_repeats(spark):
    rows = corpus(400) + [(1000, None, "", 1), (1001, "", "", 0), (1002, "12 !?", "", None), (None, "ka mo ti", "", 1), (1003, "ka mo " * 30000 + "vile", "", 0), (1004, "ka vile ti", "", 1), (1004, "ka vile ti", "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = docs.select("doc_id", "toxic")
    net = t.learn(docs.drop("toxic"), labels, F.col("doc_id") < 400)
    got = t.scored(docs.select("doc_id", "text"), net, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].score for i in (1000, 1001, 1002)] == [0, 0, 0] and sum(r.doc_id == 1004 for r in got) == 2
    assert by[1003].predicted == 1 and by[1004].predicted == 1 and by[None].predicted == 0
    assert t.learn(docs.drop("toxic"), labels.limit(0), F.lit(True)) is None
    assert [r.score for r in t.scored(docs.select("doc_id", "text").limit(2), None, ["doc_id"]).collect()] == [0, 0]


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = t.op4(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in got}
    assert share[1] > 0.8 and share[0] < 0.05
