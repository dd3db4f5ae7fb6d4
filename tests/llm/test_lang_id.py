import random

import pytest
from pyspark.sql import functions as F
from tests.llm import test_ppm

from idloom.llm import lang_id

SCHEMA = "doc_id long, text string, lang string, score int"


def corpus(n=120):
    r = random.Random(3)
    words = {"xx": ["the", "and", "of", "hand"], "yy": ["der", "und", "ich", "nicht"]}
    return [(i, " ".join(r.choices(words[l := ("xx", "yy")[i % 2]], k=30)), l, 1) for i in range(n)]


def test_accuracy_nulls_ties_and_repeats(spark):
    rows = corpus() + [(1000, None, "xx", 1), (1001, "", "xx", 1), (1002, "123 ?!", None, 1), (None, "the and of", None, 1), (1003, "the hand " * 20000, None, 1), (1004, "und nicht der", None, 1), (1004, "und nicht der", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names, models = lang_id.learn(docs, F.col("doc_id") % 3 != 1)
    assert names == ["xx", "yy"]
    got = lang_id.predict(docs, names, models, ["doc_id"]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == l for i, _, l, _ in corpus())
    assert [(by[i].lang_pred, by[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "xx" and by[1003].lang_pred == "xx" and by[1004].lang_pred == "yy"
    assert sum(r.doc_id == 1004 for r in got) == 2 and all(0 <= r.score <= 1 for r in got)


def test_against_plain_loops(spark):
    """Predictions, posteriors and code lengths by the definition, with all documents learned; a tie goes to the first language."""
    r = random.Random(8)
    train = [(i, "".join(r.choices("abc " if i % 3 == 0 else "abd ", k=r.randrange(1, 40))), ("x", "y", "z")[i % 3], 0) for i in range(24)]
    train += [(100 + i, t, "yy", 0) for i, t, l, _ in train if l == "y"]  # y and yy are learned alike
    texts = ["".join(r.choices("abcd\u00e9 ", k=r.randrange(1, 30))) + "a" for _ in range(30)] + ["é", "b" * 500]
    names, models = lang_id.learn(spark.createDataFrame(train, SCHEMA), F.lit(True), order=2)
    got = lang_id.predict(spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], SCHEMA), names, models, ["doc_id"], order=2).collect()
    assert names == ["x", "y", "yy", "z"]
    for row in got:
        raw = texts[row.doc_id].encode()
        bits = {n: test_ppm.brute([t.encode() for _, t, l, _ in train if l == n], 2, raw) for n in names}
        best = min(bits.values())
        assert bits[row.lang_pred] == pytest.approx(best) and row.lang_pred != "yy"
        assert row.score == pytest.approx(1 / sum(2 ** (best - b) for b in bits.values())) and row.bits_per_byte == pytest.approx(best / (len(raw) + 1))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert lang_id.learn(docs, F.lit(True)) == ([], [])
    some = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert lang_id.predict(some, [], [], ["doc_id"]).collect()[0].lang_pred == "und"


@pytest.mark.parametrize("size", ["sf0.01"])
def test_held_out(spark, size):
    sf = f"/root/testdata/{size}"
    got = lang_id.op1(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
