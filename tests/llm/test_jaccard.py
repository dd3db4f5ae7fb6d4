import random

import corpus_pipeline as p

from idloom.llm import jaccard as j
from idloom.llm import simhash


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[k]) - both):
                a, b = find(i), find(k)
                group[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def prose(r):
    """Groups of copies with edits, long and short texts, and one passage that many share."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    texts = []
    for size in (40, 12, 3, 1, 1, 1, 1, 1, 1, 1, 1):
        base = [word() for _ in range(r.choice((20, 60, 200)))]
        base[5:5] = passage if r.random() < 0.7 else []
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 40)):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    return texts + ["One two", "one  TWO", "a b c d e", "a b c d e a b c d e", None, "", "w " * 50, "w " * 90]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, node string, component_id int")


def groups(spark, texts):
    return {r.doc_id: r.component_id for r in simhash.similar(table(spark, texts)).collect()}


def test_against_brute_force(spark, monkeypatch):
    for seed, often in ((1, 6), (2, 2)):  # often: with hardly any and with many hot shingles
        monkeypatch.setattr(j, "OFTEN", often)
        texts = prose(random.Random(seed))
        assert groups(spark, texts) == dict(enumerate(brute(texts)))
    assert simhash.similar(table(spark, ["x"]).limit(0)).collect() == []


def test_copies_that_are_no_copies_of_each_other(spark):
    """Lists that stay alive for many rounds: copies of one text, which isn't there itself, with so many edits that few are similar."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(300)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.choice((3, 5, 6, 7))):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    want = brute(texts)
    assert 5 < len(set(want)) < 60
    assert groups(spark, texts) == dict(enumerate(want))


def test_repeated_ids_and_nulls(spark):
    docs = spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (None, "A b  c d e f"), (1, None), (3, ""), (None, "x y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.similar(docs).collect()) == [(0, 0), (0, 2), (1, 1), (2, 2), (2, 2), (3, 1)]


def test_stage_removes_edited_copies(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 0").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(400)
    docs = rows.collect()
    kept = {r.doc_id for r in p.near_duplicates(spark, p.written(rows), "").collect()}
    assert kept == {docs[g].doc_id for g in brute([r.text for r in docs])}
