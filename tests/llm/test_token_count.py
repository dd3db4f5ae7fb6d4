import random

import pytest
import sentencepiece

from idloom.llm import token_count as tc


@pytest.fixture(scope="module")
def machine():
    return tc.Transducer(tc.read_pieces(tc.default_path()))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tc.default_path())


def texts():
    r = random.Random(2)
    syllables = ["the", "tion", "er", "on", "éau", "ß", "ción", " ", "  ", "\n", "\t", "▁", ".", "<s>", "<0x0A>", "日本", "😀", "\x00", "12", "3", "ing", " ", "é", "A", "THE", "==", "//", "\r\n", "lll", "aaaa"]
    return ["", " ", "   ", "\n", "a", "▁", " a  b ", "hello world", "<s></s><unk>"] + ["".join(r.choices(syllables, k=r.randrange(1, 60))) for _ in range(1500)] + ["a" * 5000, " " * 3000, "ab " * 5000, "".join(map(chr, range(1, 0x2000)))]


def test_against_library(machine, library):
    for t in texts():
        assert machine.count(t) == len(library.encode(t)), t[:80]


def test_chunks_compose_at_any_cut(machine, library):
    for t in texts()[:200]:
        for chunk in (1, 2, 3, 7):
            assert machine.count(t, chunk) == len(library.encode(t)), (t, chunk)


def unbroken():
    """Texts in which hardly a word ends, so that no chunk has a reset."""
    r = random.Random(4)
    return ["".join(r.choices("abcdefghilmnorstu", k=3000)), "thethe" * 700, "a" * 4001, "==" * 1500, "日本" * 900 + "ab" * 900, " " * 2500 + "x"]


def test_maps_of_unbroken_chunks(machine, library):
    for t in unbroken():
        marked = t.replace(" ", tc.MARK)
        maps = [machine.chunk_map(marked[i : i + 64]) for i in range(0, len(t), 64)]
        whole = machine.reduced(maps)
        for before in ("", "t", "th", "a", "=", "tion", "x"):
            state, n = machine.run(0, tc.MARK + before)
            k, after = machine.enter(whole, state)
            assert (n + k) == len(library.encode(before + t)) and (after, n + k) == machine.run(0, tc.MARK + before + marked), before


def test_long_texts_over_several_tasks(spark, library):
    rows = [(i, t) for i, t in enumerate([*unbroken(), "word and word " * 400, "", None, " " * 300])]
    got = {r.doc_id: r.n_tokens for r in tc.counted(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ["doc_id"], long=100).collect()}
    assert got == {i: len(library.encode(t or "")) for i, t in rows}


def test_documents(spark, library):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in tc.op6(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        t = r.text or ""
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens) == (len(t.encode()), len(library.encode(t)))
        assert got[r.doc_id].over_limit == (got[r.doc_id].n_tokens > 4096)


def test_nulls_repeats_and_empty_table(spark):
    schema = "doc_id long, text string, rid int, bytes string"
    rows = [(1, None, 0, ""), (1, None, 0, ""), (None, "", 1, ""), (2, "word " * 5000, 1, "")]
    got = tc.counted(spark.createDataFrame(rows, schema), ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0, r.over_limit) for r in got) == [(0, False, False), (1, False, False), (1, False, False), (2, True, True)]
    assert tc.counted(spark.createDataFrame([], schema), ["doc_id"]).collect() == []
