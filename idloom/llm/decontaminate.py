"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with up to k = floor(rate * m) edits. Cut into k + 1 pieces, at least one piece of such an
occurrence is unchanged. All pieces of a block of items are found by one automaton; a hit fixes where the item would
lie, up to k characters, hits on neighbouring diagonals share one window, and Myers' bit-parallel distance decides.
Before it, windows are dropped that keep too few of the item's q-grams for k edits (a necessary condition).

Texts and items are compared lower-cased, with white space as single spaces. Items are dealt to blocks of bounded size by
a hash. Blocks are collected and broadcast one after the other, each for one pass over the documents, so neither driver nor
executors hold an unbounded benchmark, and plans don't grow with it.

Defined results: null, empty and blank items, and null, empty and blank texts, match nothing. Items that may have no edit
(of fewer than 1 / rate characters) must occur between word borders. Texts and items are compared whole, at any length. Repeated documents
match each on their own; repeated items give one match a row. A null id is kept. Of several occurrences the one with
the smallest distance counts, of equal ones the first. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from idloom.llm.common import map_texts, table, token, worker_state, written, written_all

RATE = 0.1
#: Characters of the items of one block.
BLOCK = 512 << 10
Q = 4
MATCH = "array<struct<item_id: {}, distance: int, chars: int>>"


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(chars: int, rate: float = RATE) -> int:
    return int(rate * chars)


@dataclass(slots=True)
class Item:
    item_id: object
    text: str
    k: int
    masks: dict[str, int]
    grams: set[str]
    need: int


def prepared(item_id: object, text: str, rate: float) -> Item:
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    k, grams = budget(len(text), rate), {text[i : i + Q] for i in range(len(text) - Q + 1)}
    # every edit touches Q places of the item at most, and with them as many distinct grams
    return Item(item_id, text, k, masks, grams, len(grams) - k * Q)


def distance(item: Item, window: str) -> int:
    """The least edit distance between the item and a part of the window, by Myers."""
    m = len(item.text)
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = full, 0, m, m
    get = item.masks.get
    for c in window:
        eq = get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up <<= 1
        plus = ((down << 1) | ~(vertical | up)) & full
        minus = up & vertical
    return best


class Matcher:
    def __init__(self, items: list[tuple[object, str]], rate: float = RATE):
        self.items = [prepared(i, n, rate) for i, t in items if (n := normal(t))]
        places: dict[str, list[tuple[int, int]]] = {}
        for at, item in enumerate(self.items):
            n, m = item.k + 1, len(item.text)
            for p in range(n):
                places.setdefault(item.text[p * m // n : (p + 1) * m // n], []).append((at, p * m // n))
        self.automaton = ahocorasick.Automaton()
        for piece, own in places.items():
            self.automaton.add_word(piece, (len(piece), own))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item_id, distance, characters of the item) for every item that occurs."""
        t = normal(text)
        if not t or not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, own) in self.automaton.iter(t):
            for at, offset in own:
                starts.setdefault(at, set()).add(end + 1 - size - offset)
        out = []
        for at in sorted(starts):
            item, best = self.items[at], None
            k, m = item.k, len(item.text)
            if not k:
                if any((not s or t[s - 1] == " " or not item.text[0].isalnum() or not t[s - 1].isalnum()) and (s + m == len(t) or not t[s + m].isalnum() or not item.text[-1].isalnum()) for s in starts[at]):
                    out.append((item.item_id, 0, m))
                continue
            low = high = None
            for s in [*sorted(starts[at]), None]:
                if low is not None and (s is None or s > high + k):
                    window = t[max(0, low - k) : high + m + k]
                    if item.need <= 0 or len(item.grams.intersection([window[i : i + Q] for i in range(len(window) - Q + 1)])) >= item.need:
                        d = distance(item, window)
                        best = d if best is None else min(best, d)
                    low = None
                if low is None:
                    low = s
                high = s
            if best is not None and best <= k:
                out.append((item.item_id, best, m))
        return out


def blocks(benchmark: DataFrame, item_id: str = "item_id", item: str = "text", block: int = BLOCK) -> tuple[DataFrame, int]:
    """i, t and b (the block) of the items, dealt by block; and how many blocks there are."""
    items = benchmark.filter(F.length(F.trim(item)) > 0).select(F.col(item_id).alias("i"), F.col(item).alias("t"))
    n = max(1, -(-int(items.agg(F.sum(F.length("t"))).first()[0] or 0) // block))
    items = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int"))
    return (written(items.repartition("b"), "b") if n > 1 else items), n


def matched(docs: DataFrame, items: DataFrame, b: int, keep: list[str], text: str = "text", rate: float = RATE) -> tuple[DataFrame, Broadcast]:
    """The columns to keep and matches (array of item_id, distance, chars) with the items of a block."""
    spark = docs.sparkSession
    shared, own = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in items.filter(F.col("b") == b).select("i", "t").collect()]), token()
    kind = MATCH.format(items.schema["i"].dataType.simpleString())
    arrow = to_arrow_type(T.DataType.fromDDL(kind))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher = worker_state(own, lambda: Matcher(shared.value, rate))
        got = [[{"item_id": i, "distance": d, "chars": n} for i, d, n in matcher.matches(t)] for t in batch.column("__text").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(got, arrow)], names=[*keep, "matches"])

    return map_texts(docs.select(*keep, F.col(text).alias("__text")), "__text", run, f"{fields}matches {kind}"), shared


def leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The columns to keep, item_id, distance and chars: a row for each document and item that it holds."""
    items, n = blocks(benchmark, item_id, item, block)

    def parts() -> Iterator[DataFrame]:
        for b in range(n):
            found, shared = matched(docs, items, b, keep, text, rate)
            yield found.select(*keep, F.explode("matches").alias("m")).select(*keep, "m.item_id", "m.distance", "m.chars")
            shared.unpersist()

    return next(parts()) if n == 1 else written_all(parts())


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The documents that hold no item, with their columns."""
    names, columns = docs.columns, [f"c{i}" for i in range(len(docs.columns))]  # whatever their own names are
    own, docs = columns[names.index(text)], docs.toDF(*columns)
    items, n = blocks(benchmark, item_id, item, block)
    if n == 1:
        found, _ = matched(docs, items, 0, columns, own, rate)
        return found.filter(F.size("matches") == 0).drop("matches").toDF(*names)
    docs = written(docs.withColumn("rid", F.monotonically_increasing_id()))  # ids are given once and written with the rows

    def parts() -> Iterator[DataFrame]:
        for b in range(n):
            found, shared = matched(docs, items, b, ["rid"], own, rate)
            yield found.filter(F.size("matches") > 0).select("rid")
            shared.unpersist()

    return docs.join(written_all(parts()), "rid", "left_anti").select(*columns).toDF(*names)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, chars: every benchmark item that a document holds."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])


QUERIES = {"op2_decontaminate": op2}
SQL: dict[str, str] = {}
