import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from idloom.llm import bpe


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(open(bpe.default_path(), encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Library.from_file(bpe.default_path())


def texts():
    r = random.Random(4)
    bits = ["the", "Tion", "ER", " ", "  ", "\n", "\t", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|", "12", "3", "é", "ß", "éau", "é", "日本", "Σ", "ΑΣ", "İ", "😀", "\x00", "\x85", "　", "…", "€", "--", "!!", "ñ", "ſ", "ͅ", "١", "aaaa", "ing", "ͅ"]
    return ["", " ", "<|endoftext|>", "a" * 20000, "ab " * 5000] + ["".join(r.choices(bits, k=r.randrange(1, 50))) for _ in range(2000)] + ["".join(map(chr, range(1, 0xD7FF)))]


def test_against_library(own, library):
    every = texts()
    want = library.encode_batch(every, add_special_tokens=False)
    for at in range(0, len(every), 97):
        for t, (ids, decoded), w in zip(every[at : at + 97], own.encode_batch(every[at : at + 97]), want[at : at + 97], strict=True):
            assert np.frombuffer(ids, np.int32).tolist() == w.ids, t[:80]
            assert decoded == library.decode(w.ids, skip_special_tokens=False), t[:80]


def test_all_words_at_once_as_each_alone(own):
    def alone(word):
        word = [own.vocab[c] for c in word[:-1]] + [own.vocab[word[-1] + own.end]]
        while True:
            ranked = [(own.ranks[a << 20 | b], i) for i, (a, b) in enumerate(zip(word, word[1:], strict=False)) if a << 20 | b in own.ranks]
            if not ranked:
                return word
            rank, i = min(ranked)
            word[i : i + 2] = [own.merges[rank][2]]

    r = random.Random(6)
    words = ["".join(r.choices("abcdeinorstu", k=r.randrange(1, 30))) for _ in range(500)] + ["a" * n for n in range(1, 40)]
    assert own.merged([w.encode() for w in words]) == [alone(w) for w in words]


def test_lower_rank_made_by_a_merge_goes_first(own, monkeypatch):
    # ab: 1, c after ab: 0, so in abcab the c joins before the second ab is made
    a, b, c = (own.vocab[x] for x in "abc")
    be = own.vocab["b</w>"]
    made = {0: (300, c, 301), 1: (a, b, 300), 2: (301, a, 302), 3: (a, be, 303), 4: (302, be, 304)}
    monkeypatch.setattr(own, "merges", [made[i] for i in range(5)])
    monkeypatch.setattr(own, "ranks", {x << 20 | y: i for i, (x, y, _) in made.items()})
    monkeypatch.setattr(own, "first_ranks", np.array([[own.ranks.get(int(x) << 20 | int(y), -1) for y in own.first] for x in own.first]))
    assert own.merged([b"abcab", b"ab"]) == [[304], [303]]


def test_documents(spark, library):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in bpe.op10(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[r.doc_id][1:] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_nulls_repeats_and_empty_table(spark):
    schema = "doc_id long, text string, ids int, decoded string"
    rows = [(1, None, 0, ""), (None, "", 1, ""), (2, "word", 1, ""), (2, "word", 1, "")]
    got = bpe.encoded(spark.createDataFrame(rows, schema), ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in got) == [(0, 0, ""), (1, 0, ""), (2, 1, "word</w>"), (2, 1, "word</w>")]
    assert bpe.encoded(spark.createDataFrame([], schema), ["doc_id"]).collect() == []


def test_each_plain_character_against_library(own, library):
    chars = [chr(i) for i in (*range(0x300), *range(0x2010, 0x2028), 0x20AC)]
    every = [t for c in chars for t in (c, f"a{c}b", f"!{c}?", f"1{c}2", f"A{c}{c} {c}", f"'{c}s")]
    want = library.encode_batch(every, add_special_tokens=False)
    for t, (ids, _), w in zip(every, own.encode_batch(every), want, strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == w.ids, ascii(t)
