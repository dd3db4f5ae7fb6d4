"""Token counts of a piece vocabulary (BPE with byte fallback) by a compiled finite-state transducer.

In BPE the last token of a prefix's encoding fixes the rest: the encoding of text[:i] is that of
text[:j] and one token text[j:i], and that token is the only one that ends there and keeps its border to
the token before it when both are encoded alone. So whatever a prefix's future needs is the set of suffixes that may
still grow into a piece, each with the token before it and the count there. These sets are the states of a
deterministic transducer over characters; a transition emits how many tokens the count changes by
(it may be negative: a character can close a longer piece). States and transitions are compiled when first met,
kept within a bound, and are pure functions of the vocabulary.

Pieces hold word marks only at their start, and characters without a piece become bytes, so at a mark after
another character, and after such a character, the transducer is back in its first state. A text is cut
into chunks at any place. A chunk's state map gives count and state for every state that it is entered in: it holds those for the
first state, and for others runs both side by side until they meet, which they do at a reset at the latest and
otherwise soon, as encodings fall into step; from there on the counts are the same. Maps compose associatively, and a text's
count is their reduction as in a parallel prefix scan: chunks of a piece in one task, pieces of long texts (LONG characters)
across tasks. Words are kept in a table with the maps they stand for.

Defined results: null and empty texts have no tokens. Any Unicode text, long words and long texts are
counted whole. Rows repeat as in the input; null ids are kept; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from idloom.llm.common import map_texts, table, token, worker_state, written

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
#: States that a worker keeps before it starts anew, words in each of two generations, and the longest of them.
STATES, WORDS, LONGEST_WORD = 400_000, 250_000, 24
#: Pairs of tokens whose border a worker keeps.
BORDERS = 400_000
#: Characters of a chunk, and of a piece that one task maps.
CHUNK, LONG = 1 << 16, 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The mergeable pieces and their scores; bounded by the vocabulary."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]


@dataclass(slots=True)
class ChunkMap:
    """count and state if entered in the first state. head: the characters before the first reset, or all; parts: the maps it is composed of."""

    count: int
    state: int
    head: str = ""
    reset: bool = False
    parts: tuple[ChunkMap, ChunkMap] | None = None


def first_reset(m: ChunkMap) -> tuple[str, bool]:
    """The characters of a map's text before its first reset, and whether there is one."""
    heads = []
    while m.parts:
        head, reset = first_reset(m.parts[0])
        heads.append(head)
        if reset:
            return "".join(heads), True
        m = m.parts[1]
    return "".join([*heads, m.head]), m.reset


class Transducer:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.score = dict(pieces)
        self.names = list(self.score)
        number = {p: i for i, p in enumerate(self.names)}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for p, i in number.items():
            if MARK in p.lstrip(MARK):
                raise ValueError(f"the piece {p!r} crosses a word mark")
            at = 0
            for c in p:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.ends)
                    self.children.append({})
                    self.ends.append(-1)
                at = self.children[at][c]
            self.ends[at] = i
        self.chars = {c for p in self.names for c in p}
        if lone := [c for c in self.chars if c not in number]:
            raise ValueError(f"characters without a piece of their own: {lone[:5]}")
        barrier = "" if "\n" in self.chars else "\n"
        self.words = re.compile(f"{MARK}*[^{MARK}{barrier}]+|{MARK}+" + f"|{barrier}+" * bool(barrier))
        self.table: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self._restart()

    def _restart(self) -> None:
        self.borders: dict[tuple[int, int], bool] = {}
        self.sets: list[tuple] = [((0, -1, 0),)]
        self.ids: dict[tuple, int] = {self.sets[0]: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """BPE by definition, for two pieces at a time."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def border(self, a: int, b: int) -> bool:
        """Whether two tokens stay apart."""
        if (a, b) not in self.borders:
            if len(self.borders) >= BORDERS:
                self.borders.clear()
            self.borders[a, b] = self.merged(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
        return self.borders[a, b]

    def compile(self, state: int, char: str) -> tuple[int, int]:
        if char not in self.chars:
            out = (0, len(char.encode()))
        else:
            grown, found = [], []
            for node, before, count in self.sets[state]:
                to = self.children[node].get(char)
                if to is not None:
                    grown.append((to, before, count))
                    if (t := self.ends[to]) >= 0 and (before < 0 or self.border(before, t)):
                        found.append((count + 1, t))
            (delta, last), = found
            out = (self.state_of((*((n, b, c - delta) for n, b, c in grown if self.children[n]), (0, last, 0))), delta)
        self.next[state][char] = out
        return out

    def state_of(self, entries: tuple) -> int:
        """The number of a state in this worker; entries mean the same in all."""
        if (to := self.ids.get(entries)) is None:
            to = self.ids[entries] = len(self.sets)
            self.sets.append(entries)
            self.next.append({})
        return to

    def run(self, state: int, text: str) -> tuple[int, int]:
        count, steps = 0, self.next
        for c in text:
            to = steps[state].get(c)
            if to is None:
                to = self.compile(state, c)
            state = to[0]
            count += to[1]
        return state, count

    def word(self, text: str) -> int:
        n = self.table.get(text)
        if n is None:
            n = self.older.get(text)
            if n is None:
                n = self.run(0, text)[1]
            if len(text) <= LONGEST_WORD:
                self.table[text] = n
        return n

    def chunk_map(self, text: str) -> ChunkMap:
        """Of marked text. A word of the text starts at a reset if the character before it is no mark."""
        first = re.search(f"(?<=[^{MARK}]){MARK}", text)
        if not first:
            state, n = self.run(0, text)
            return ChunkMap(n, state, text)
        head, rest = text[: first.start()], self.words.findall(text, first.start())
        tail = rest.pop()
        known = self.table
        counts = [known.get(w) for w in rest]
        total = sum(self.word(w) if n is None else n for w, n in zip(rest, counts, strict=True)) if None in counts else sum(counts)
        state, n = self.run(0, tail)
        return ChunkMap(self.run(0, head)[1] + total + n, state, head, True)

    def enter(self, m: ChunkMap, state: int) -> tuple[int, int]:
        """Count and state after the map's text, from any state before it."""
        if state == 0:
            return m.count, m.state
        if m.parts:
            a, b = m.parts
            n, s = self.enter(a, state)
            if s == a.state:
                return m.count - a.count + n, m.state
            k, s = self.enter(b, s)
            return n + k, s
        steps, first, more = self.next, 0, 0
        for c in m.head:
            x, y = steps[first].get(c) or self.compile(first, c), steps[state].get(c) or self.compile(state, c)
            first, state = x[0], y[0]
            more += y[1] - x[1]
            if first == state:
                break
        return m.count + more, m.state if m.reset or first == state else state

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        n, state = self.enter(b, a.state)
        return ChunkMap(a.count + n, state, parts=(a, b))

    def reduced(self, maps: list[ChunkMap]) -> ChunkMap:
        """The map of them all, at least one, composed in pairs."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def text_map(self, marked: str, chunk: int = CHUNK) -> ChunkMap:
        if len(self.sets) > STATES:
            self._restart()
        if len(self.table) > WORDS:
            self.table, self.older = {}, self.table
        return self.reduced([self.chunk_map(marked[i : i + chunk]) for i in range(0, len(marked), chunk)])

    def count(self, text: str, chunk: int = CHUNK) -> int:
        return self.text_map(MARK + text.replace(" ", MARK), chunk).count if text else 0


_STATE = "array<struct<node: int, before: int, count: int>>"


def counted(docs: DataFrame, keep: list[str], text: str = "text", limit: int = LIMIT, path: str | None = None, long: int = LONG) -> DataFrame:
    """The columns to keep, n_bytes, n_tokens, over_limit."""
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(path or default_path()))
    own = token()
    names = [f"k{i}" for i in range(len(keep))]  # whatever their own names are
    size = F.length("t")
    starts = F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(long))
    source = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.coalesce(text, F.lit("")).alias("t"))
    # ids are given once and written with the rows
    pieces = source.withColumn("rid", F.monotonically_increasing_id()).select(*names, "bytes", "rid", F.posexplode(F.when(size <= long, F.array("t")).otherwise(F.transform(starts, lambda i: F.substring("t", i, F.lit(long))))).alias("pos", "t"), (size > long).alias("cut"))
    fields = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, source.schema.fields, strict=False))
    arrow = to_arrow_type(T.DataType.fromDDL(_STATE))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = worker_state(own, lambda: Transducer(shared.value))
        counts, heads, resets, states = [], [], [], []
        for t, pos, cut in zip(*(batch.column(c).to_pylist() for c in ("t", "pos", "cut")), strict=True):
            if not cut:
                counts.append(machine.count(t))
                heads.append(None)
                resets.append(None)
                states.append(None)
                continue
            m = machine.text_map(MARK * (pos == 0) + t.replace(" ", MARK))
            head = first_reset(m)
            counts.append(m.count)
            heads.append(head[0])
            resets.append(head[1])
            states.append([dict(zip(("node", "before", "count"), e, strict=True)) for e in machine.sets[m.state]])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*names, "bytes", "rid", "pos")), pa.array(counts, pa.int64()), pa.array(heads, pa.string()), pa.array(resets, pa.bool_()), pa.array(states, arrow)], names=[*names, "bytes", "rid", "pos", "n", "head", "reset", "state"])

    def join(t: pa.Table) -> pa.Table:
        machine = worker_state(own, lambda: Transducer(shared.value))
        rows = t.sort_by("pos").to_pylist()
        state_of = lambda row: machine.state_of(tuple((e["node"], e["before"], e["count"]) for e in row["state"]))
        whole = machine.reduced([ChunkMap(r["n"], state_of(r), r["head"], r["reset"]) for r in rows])
        return pa.table({"rid": pa.array([rows[0]["rid"]], pa.int64()), "whole": pa.array([whole.count], pa.int64())})

    mapped = written(map_texts(pieces, "t", run, f"{fields}bytes long, rid long, pos int, n long, head string, reset boolean, state {_STATE}"))
    # the pieces of a long text meet again by their maps: heads are short but where no word ends
    sums = mapped.filter("state is not null").select("rid", "pos", "n", "head", "reset", "state").groupBy("rid").applyInArrow(join, "rid long, whole long")
    counts_ = mapped.filter("pos = 0").join(sums, "rid", "left").withColumn("n_tokens", F.coalesce("whole", "n"))
    return counts_.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    return counted(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


QUERIES = {"op6_token_count": op6}
SQL: dict[str, str] = {}
