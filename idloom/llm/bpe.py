"""BPE encoding and decoding with a pair occurrence index.

The words of a partition are taken by pieces of about 2 MB of its texts; those of a piece that aren't in the worker's word table yet
are laid out as one linked list of symbols. An index maps every pair to all its positions; ranks with occurrences are active and taken in ascending
order; the positions of a rank merge from left to right and the lists of the neighbouring pairs are updated.
If a merge makes a pair of lower rank active, that rank goes first, as in encoding word by word.

Texts are split into words as the tokenizer file says: special tokens, normalisation (NFC, white space, lower
case), pattern, byte symbols, word ends. Characters on which all versions of Unicode agree take compiled
patterns; texts with others go through the library's own normaliser and splitter.
Decoding joins token names with spaces, as the library does for a file without a decoder.

Defined results: null and empty texts have no ids and decode to an empty text. Texts are encoded whole. Rows
repeat as in the input; null ids are kept; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm.common import map_texts, table, token, worker_state

VOCABULARY = "word_bpe_49k.json"
#: The word pattern that plain_pattern stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that a worker keeps in each of two generations, and the longest of them.
WORDS, LONGEST_WORD = 250_000, 32
_HALF = 20  # bits of an id in a pair
#: U+023A and U+023E are left out: their lower case lies above U+02FF.
_OTHER = re.compile("[^\x00-\u0239\u023b-\u023d\u023f-\u02ff\u2010-\u2027\u20ac]")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def plain_pattern() -> re.Pattern:
    """The word pattern for texts in lower case of the characters that _OTHER leaves: their letters, numbers and white space."""
    chars = [chr(i) for i in (*range(0x300), *range(0x2010, 0x2028), 0x20AC)]
    kind = {k: "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == k) for k in "LN"}
    return re.compile(f"{_CONTRACTIONS}|[{kind['L']}]+|[{kind['N']}]|[^\t-\r \x85\xa0{kind['L']}{kind['N']}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_symbols() -> list[str]:
    """Printable bytes stand for themselves, the others for the code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else more))
        more += b not in shown
    return out


class Tokenizer:
    def __init__(self, text: str):
        """text: the tokenizer file."""
        from tokenizers import Tokenizer as Library

        spec = json.loads(text)
        model = spec["model"]
        if spec["decoder"] is not None or model["type"] != "BPE" or model["unk_token"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError("the file asks for what this tokenizer doesn't do")
        library = Library.from_str(text)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError("the file splits words in a way that this tokenizer doesn't")
        self.pattern = plain_pattern()
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.byte = {c: b for b, c in enumerate(symbols)}
        #: Ids of the first symbols: of the 256 bytes, then of the same at a word's end.
        self.first = np.array([self.vocab[c + e] for e in ("", self.end) for c in symbols], np.int64)
        self.ranks: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y = self.vocab[left], self.vocab[right]
            self.merges.append((x, y, self.vocab[left + right]))
            self.ranks[x << _HALF | y] = rank
        self.first_ranks = np.array([[self.ranks.get(int(x) << _HALF | int(y), -1) for y in self.first] for x in self.first], np.int64)
        self.name = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}
        self.older: tuple[dict[str, bytes], dict[str, str]] = {}, {}

    def words(self, text: str) -> list[str]:
        if not text.isascii() and _OTHER.search(text):
            return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return self.pattern.findall(text.lower())  # no word holds white space, so its form doesn't matter

    def raw(self, word: str, mapped: bool) -> bytes:
        return bytes(map(self.byte.__getitem__, word)) if mapped else word.encode()

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Encodes all words at once, each as if alone."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes) - 1
        start = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start[ends] += 256
        rank = np.full(len(start), -1)
        rank[:-1] = self.first_ranks[start[:-1], start[1:]]
        rank[ends] = -1
        places = np.flatnonzero(rank >= 0)
        places = places[np.argsort(rank[places], kind="stable")]
        found, at = np.unique(rank[places], return_index=True)
        index = dict(zip(found.tolist(), [p.tolist() for p in np.split(places, at[1:])], strict=False))
        active = found.tolist()  # sorted: a heap
        after, before = np.arange(1, len(start) + 1), np.arange(-1, len(start) - 1)
        after[ends] = -1
        before[ends[:-1] + 1] = -1
        ids, after, before = self.first[start].tolist(), after.tolist(), before.tolist()
        merges, lookup = self.merges, self.ranks.get
        while active:
            now = heappop(active)
            left, right, new = merges[now]
            at = index.pop(now)
            at.sort()
            for k, i in enumerate(at):
                n = after[i]
                if ids[i] != left or n < 0 or ids[n] != right:
                    continue
                ids[i], ids[n] = new, -1
                after[i] = m = after[n]
                lower = False
                if m >= 0:
                    before[m] = i
                    if (r := lookup(new << _HALF | ids[m])) is not None:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heappush(active, r)
                            lower = r < now
                p = before[i]
                if p >= 0 and (r := lookup(ids[p] << _HALF | new)) is not None:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heappush(active, r)
                        lower |= r < now
                if lower and k + 1 < len(at):
                    # what is left of this rank waits; the same rank may have become active anew
                    if now in index:
                        index[now].extend(at[k + 1 :])
                    else:
                        index[now] = at[k + 1 :]
                        heappush(active, now)
                    break
        ids = np.array(ids)
        kept = ids >= 0
        cuts = np.cumsum(kept)[ends].tolist()
        ids = ids[kept].tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.name[i] for i in ids])

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids, as native 32-bit integers, and what they decode to."""
        if len(self.ids_of) > WORDS:
            self.older, self.ids_of, self.text_of = (self.ids_of, self.text_of), {}, {}
        ids_of, text_of, (old_ids, old_text) = self.ids_of, self.text_of, self.older
        split: list[list[list[str]]] = []
        fresh: dict[str, bytes] = {}
        for t in texts:
            parts = []
            for part in (self.cut.split(t) if "<|" in t else (t,)) if t else ():
                if part in self.special:
                    # a space before a key tells it from words, which hold none
                    key = f" {part}"
                    ids_of[key], text_of[key] = array("i", [self.special[part]]).tobytes(), part
                    parts.append([key])
                elif part:
                    words, mapped = self.words(part), not part.isascii() and bool(_OTHER.search(part))
                    words = [f"  {w}" for w in words] if mapped else words
                    parts.append(words)
                    for w in set(words).difference(ids_of):
                        if w in old_ids:
                            ids_of[w], text_of[w] = old_ids[w], old_text[w]
                        elif w not in fresh:
                            fresh[w] = self.raw(w[2:] if mapped else w, mapped)
            split.append(parts)
        name = self.name
        for w, ids in zip(fresh, self.merged(list(fresh.values())), strict=True):
            ids_of[w], text_of[w] = array("i", ids).tobytes(), " ".join([name[i] for i in ids])
        out = [(b"".join([b"".join(map(ids_of.__getitem__, w)) for w in parts]), " ".join([" ".join(map(text_of.__getitem__, w)) for w in parts if w])) for parts in split]
        for w in fresh:
            if len(w) > LONGEST_WORD:
                del ids_of[w], text_of[w]
        return out


def encoded(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns to keep, ids (array of int), decoded (string)."""
    with open(path or default_path(), encoding="utf-8") as f:  # on the driver; its size is that of a vocabulary
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    own = token()
    kept = docs.select(*keep).schema
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.fields)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = worker_state(own, lambda: Tokenizer(shared.value))
        got = tokenizer.encode_batch(batch.column("__text").to_pylist())
        ids = pa.array(np.frombuffer(b"".join([g[0] for g in got]), np.int32))
        offsets = np.concatenate(([0], np.cumsum([len(g[0]) // 4 for g in got]))).astype(np.int32)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(offsets, ids), pa.array([g[1] for g in got], pa.string())], names=[*keep, "ids", "decoded"])

    return map_texts(docs.select(*keep, F.col(text).alias("__text")), "__text", run, f"{fields}ids array<int>, decoded string")


def digests(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.select(*keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    return digests(encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]), ["doc_id"])


QUERIES = {"op10_bpe": op10}
SQL: dict[str, str] = {}
