"""Prediction by partial matching over bytes, with frozen counts.

A text is a sequence of byte symbols closed by an end symbol. A model holds, for every context of up
to `order` symbols that was seen, the counts of the symbols that followed. The probability of a symbol
is method D's: in the longest known context, (2c - 1) / 2n for a symbol seen c times there among n with
d distinct ones, else the escape d / 2n and the next shorter context with the symbols of the longer
one excluded; below the empty context all symbols left are equally likely. The longest contexts count
occurrences, shorter ones the distinct longer contexts in which a symbol followed (update exclusion, frozen). So
the symbols of a context are among those of its suffix, which is why what an exclusion removes depends on
one context only and can be tabled when the model is compiled.

With frozen counts the code length of a symbol is a function of the last `order` symbols and itself: one
64-bit window. Scores are computed once for each window and kept in a slot table of fixed size.
"""

from __future__ import annotations

import numpy as np

BITS = 9
END, START = 256, 257
SYMBOLS = 257
MAX_ORDER = 6


def windows(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the windows of all texts, and where each text's windows begin and end; after each end
    follow `order` windows that belong to no text."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = b"\0" * (order + 1)
    raw = np.frombuffer(b"\0" * order + gap.join(texts) + gap, dtype=np.uint8)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + order + 1)))
    ends = starts + lengths + 1
    symbols = raw.astype(np.int64)
    symbols[:order] = START
    symbols[ends - 1 + order] = END
    if order:
        symbols[(ends[:, None] + order + np.arange(order)[None, :]).ravel()] = START
    n = len(symbols) - order
    keys = symbols[order:].copy()
    for j in range(1, order + 1):
        keys |= symbols[order - j : order - j + n] << (BITS * j)
    return keys, starts, ends


def window_counts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    keys, _, _ = windows(texts, order)
    keys = keys[(keys & ((1 << BITS) - 1)) != START]
    return np.unique(keys, return_counts=True)


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    at = np.argsort(keys, kind="stable")
    keys, counts = keys[at], counts[at]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def levels_of(keys: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Window counts of the orders 0 to `order`, from those of the last (sorted and distinct): a shorter window counts
    the distinct ones that are longer by a symbol."""
    levels = [(keys, counts)]
    for j in range(order - 1, -1, -1):
        keys, counts = merge_counts([(keys & ((1 << BITS * (j + 1)) - 1), np.ones(len(keys), np.int64))])
        levels.append((keys, counts))
    return levels[::-1]


class Model:
    """A compiled context tree, from sorted window counts of each order. A longer order may leave out windows, if every
    one that it keeps has its shorter ones kept."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(levels) - 1
        self.pairs, self.cost, self.contexts, self.escape, self.total, self.chain, self.left = [], [], [], [], [], [], []
        low_n = low_d = None
        for j, (k, c) in enumerate(levels):
            first = np.flatnonzero(np.concatenate(([True], (k[1:] >> BITS) != (k[:-1] >> BITS)))) if len(k) else np.zeros(0, np.int64)
            x = k[first] >> BITS
            n = np.add.reduceat(c, first).astype(np.float64) if len(k) else np.zeros(0)
            d = np.diff(np.concatenate((first, [len(k)]))).astype(np.float64)
            self.pairs.append(k)
            self.cost.append(np.log2(2.0 * c - 1))
            self.contexts.append(x)
            self.total.append(np.log2(2 * n))
            self.escape.append(np.log2(2 * n) - np.log2(d))
            if j == 0:
                self.left.append(np.zeros(len(x)))
                self.chain.append(np.zeros(len(x)))
            else:
                suffix = np.searchsorted(self.contexts[j - 1], x & ((1 << BITS * (j - 1)) - 1))
                below = np.searchsorted(levels[j - 1][0], k & ((1 << BITS * j) - 1))
                shared = np.add.reduceat(levels[j - 1][1][below], first).astype(np.float64) if len(k) else np.zeros(0)
                rest = low_d[suffix] - d
                z = np.log2(np.maximum(2 * (low_n[suffix] - shared), 1))
                self.left.append(z)
                self.chain.append(self.chain[j - 1][suffix] + np.where(rest > 0, z - np.log2(np.maximum(rest, 1)), 0))
            low_n, low_d = n, d
        self.unseen = float(np.log2(max(1, SYMBOLS - len(levels[0][0])))) if len(levels[0][0]) else float(np.log2(SYMBOLS))
        self.empty = not len(levels[0][0])

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last symbol of each window."""
        if self.empty:
            return np.full(len(keys), self.unseen)
        out = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)  # the symbol isn't found yet
        top = np.zeros(len(keys), bool)  # a known context was met
        ahead = np.zeros(len(keys))  # the chain of the longest known context, and its escape
        longer_left, longer_chain = np.zeros(len(keys)), np.zeros(len(keys))
        for j in range(self.order, -1, -1):
            x, p = (keys >> BITS) & ((1 << BITS * j) - 1), keys & ((1 << BITS * (j + 1)) - 1)
            xs, ps = self.contexts[j], self.pairs[j]
            if not len(xs):
                continue
            i = np.minimum(np.searchsorted(xs, x), len(xs) - 1)
            known = xs[i] == x
            q = np.minimum(np.searchsorted(ps, p), len(ps) - 1)
            seen = (ps[q] == p) & open_
            out = np.where(seen & ~top, self.total[j][i] - self.cost[j][q], out)
            out = np.where(seen & top, ahead - longer_chain + longer_left - self.cost[j][q], out)
            open_ &= ~seen
            fresh = known & ~top & open_
            ahead = np.where(fresh, self.escape[j][i] + self.chain[j][i], ahead)
            top |= fresh
            longer_left, longer_chain = np.where(known, self.left[j][i], longer_left), np.where(known, self.chain[j][i], longer_chain)
        return np.where(open_, np.where(top, ahead, 0) + self.unseen, out)


class Scorer:
    """Code lengths of whole texts under one or more models of one order."""

    def __init__(self, models: list[Model], order: int, slots: int = 19):
        self.models, self.order, self.shift = models, order, np.uint64(64 - slots)
        self.key = np.full(1 << slots, -1, np.int64)
        self.value = np.zeros((1 << slots, len(models)))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def window_bits(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        missing = np.flatnonzero(self.key[slot] != keys)
        out = self.value[slot]
        if len(missing):
            fresh, back = np.unique(keys[missing], return_inverse=True)
            bits = np.stack([m.bits(fresh) for m in self.models], axis=1)
            out[missing] = bits[back]
            slot = self._slot(fresh)
            self.key[slot], self.value[slot] = fresh, bits
        return out

    def bits(self, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
        """A row for each text, a column for each model. Works through the windows in blocks, so memory
        doesn't follow the length of a text."""
        out = np.zeros((len(texts), len(self.models)))
        if not texts:
            return out
        keys, starts, ends = windows(texts, self.order)
        for at in range(0, len(keys), block):
            part = np.concatenate((self.window_bits(np.ascontiguousarray(keys[at : at + block])), np.zeros((1, len(self.models)))))
            a, b = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + block, "left")
            if a < b:
                edges = np.stack((np.maximum(starts[a:b] - at, 0), np.minimum(ends[a:b] - at, len(part) - 1)), axis=1).ravel()
                out[a:b] += np.add.reduceat(part, edges, axis=0)[::2]
        return out
