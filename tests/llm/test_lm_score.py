import math
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from idloom.llm import lm_score as s
from tests.llm.test_ppm import brute

SCHEMA = "doc_id long, text string, n int, word string"
SPACES = str.maketrans("\t\n\v\f\r", "     ")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.translate(SPACES).split(" ") if w]


def base(rows):
    c = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c.update([*words(t), ""])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = [*words(t), ""]
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return s.scored(df, F.col("doc_id").isNotNull() & ~fold, ["doc_id"], **options).collect()


def same(got, want):
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted((i or -1, a, b, c, round(d, 6)) for i, a, b, c, d in want)


def test_against_definitions(spark):
    rows = [(i, t) for i, t in enumerate(["the Cat sat", "the the\tdog\n", "", None, "a\x1cb é\x85c", "THE ÉTÉ dog", "x" * 300, "cat cat cat", "the", "dog the cat"] * 3)] + [(None, "the unseen"), (7, "cat cat cat"), (7, "cat cat cat")]
    train = [b" ".join(w.encode() for w in words(t)) for i, t in rows if i is not None and not held(i)]
    for options in ({}, {"hot": 2}, {"hot": 0}):
        got = run(spark, rows, order=3, **options)
        same(got, base(rows))
        text = {i: t for i, t in rows}
        for r in got:
            want = -brute(train, 3, b" ".join(w.encode() for w in words(text[r.doc_id]))) * math.log10(2)
            assert abs(r.score - want) < 1e-6


def test_adaptive_learns():
    assert s.adaptive("abc " * 50) > 12 * s.adaptive("abc " * 4)
    assert abs(s.adaptive(None) + math.log10(257)) < 1e-9


def test_nothing_to_learn_from(spark):
    assert run(spark, []) == []
    (r,) = run(spark, [(None, "a")])
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0) and abs(r.score + 2 * math.log10(257)) < 1e-9


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = s.op3(spark, sf).collect()
    same(got, base(rows))
    out = [r for r in got if r.held_out]
    assert all(r.held_out == held(r.doc_id) for r in got) and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_do_not_depend_on_the_size_of_the_table(spark):
    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choices("abcdE", k=r.randrange(1, 6))) for _ in range(r.randrange(30)))) for i in range(60)]
    text = dict(rows)
    train = [b" ".join(w.encode() for w in words(t)) for i, t in rows if not held(i)]
    for nodes in (0, 40, 2_000_000):
        for x in run(spark, rows, order=5, nodes=nodes):
            want = -brute(train, 5, b" ".join(w.encode() for w in words(text[x.doc_id]))) * math.log10(2)
            assert abs(x.score - want) < 1e-6, (nodes, x.doc_id)


def test_contexts_of_six_bytes(spark):
    rows = [(i, t) for i, t in enumerate(["1abcdex", "2abcdey", "1abcdex", "2abcdey", "3abcdez"] * 6)]
    text = dict(rows)
    train = [b" ".join(w.encode() for w in words(t)) for i, t in rows if not held(i)]
    for x in run(spark, rows):
        want = -brute(train, 6, text[x.doc_id].encode()) * math.log10(2)
        assert abs(x.score - want) < 1e-6
