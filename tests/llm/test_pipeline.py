import random

import corpus_pipeline as p
from tests.llm import test_decontaminate, test_jaccard, test_pii
from tokenizers import Tokenizer

from idloom.llm import bpe, decontaminate

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}

    docs = p.written(p.language(spark, docs, SF))
    rows = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and {i for i, r in before.items() if i not in rows} <= {i for i, r in before.items() if r.lang is None or len(r.text or "") < 200}
    assert all(rows[i] == before[i] for i in rows)

    order = sorted(rows)
    group = test_jaccard.brute([rows[i].text for i in order])
    docs = p.written(p.near_duplicates(spark, docs, SF))
    kept = {r.doc_id: r for r in docs.collect()}
    assert set(kept) == {order[g] for g in group} and docs.columns == columns and len(kept) < len(rows)

    docs = p.written(p.decontamination(spark, docs, SF))
    clean = {r.doc_id: r for r in docs.collect()}
    # the exact occurrences by search, and that no other document goes
    assert set(clean) == {i for i, r in kept.items() if not any(t in decontaminate.normal(r.text) for _, t in items)} and docs.columns == columns
    assert len(clean) < len(kept)

    docs = p.written(p.personal_data(spark, docs, SF))
    out = {r.doc_id: r for r in docs.collect()}
    assert set(out) == set(clean) and docs.columns == columns
    for i, r in clean.items():
        want, end = "", 0
        for s, k, e in test_pii.brute(r.text):
            if s >= end:
                want += r.text[end:s] + "[" + ("email", "ip", "card", "phone")[k] + "]"
            end = max(end, e)
        assert out[i].text == want + r.text[end:] and out[i].n_chars == len(out[i].text)

    library = Tokenizer.from_file(bpe.default_path())
    ids = {r.doc_id: r for r in p.encoding(spark, docs, SF).collect()}
    assert {i: r.ids for i, r in ids.items()} == {i: library.encode(r.text, add_special_tokens=False).ids for i, r in out.items()}
    assert {r.doc_id: r.ids for r in p.run(spark, SF).collect()} == {i: r.ids for i, r in ids.items()}


def test_odd_rows(spark):
    r = random.Random(1)
    word = lambda: test_decontaminate.phrases(r, 1)
    text = " ".join(word() for _ in range(60))
    other = " ".join(word() for _ in range(60))
    third = " ".join(word() for _ in range(60))
    rows = [(1, text, "en", "s", 1, "x"), (1, text, "en", "s", 1, "x"), (2, text, None, "s", 1, "x"), (None, text, "en", None, None, "x"), (3, None, "en", "s", 0, "x"), (4, "", "en", "s", 0, "x"), (5, "123", "en", "s", 3, "x"), (6, other, "en", "s", 1, None), (None, third, "en", "s", 1, "x"), (7, "word " * 30000, "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
    for _, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, SF))
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key"]
    assert sorted((x.doc_id or 0, x.n_chars) for x in docs.collect()) == sorted([(1, len(text)), (6, len(other)), (0, len(third)), (7, 150000)])
    none = spark.createDataFrame([], docs.schema)
    for _, stage in p.STAGES:
        none = stage(spark, none, SF)
    assert none.collect() == []
