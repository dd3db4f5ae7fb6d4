import math
import random
from collections import Counter

import numpy as np

from idloom.llm import ppm


def brute(train, order, text):
    """Straight from the definition: dictionaries of contexts, exclusion by sets."""
    tree = {}
    for t in train:
        s = [ppm.START] * order + list(t) + [ppm.END]
        for i in range(order, len(s)):
            tree.setdefault(tuple(s[i - order : i]), Counter())[s[i]] += 1
    for j in range(order, 0, -1):
        for context, at in [x for x in tree.items() if len(x[0]) == j]:
            tree.setdefault(context[1:], Counter()).update(set(at))
    s = [ppm.START] * order + list(text) + [ppm.END]
    bits = 0.0
    for i in range(order, len(s)):
        out, done = set(), False
        for j in range(order, -1, -1):
            at = tree.get(tuple(s[i - j : i]))
            if not at:
                continue
            left = {k: v for k, v in at.items() if k not in out}
            n, d = sum(left.values()), len(left)
            if s[i] in left:
                bits -= math.log2((2 * left[s[i]] - 1) / (2 * n))
                done = True
                break
            if d:
                bits -= math.log2(d / (2 * n))
            out |= set(at)
        if not done:
            bits += math.log2(ppm.SYMBOLS - len(out))
    return bits


def test_against_definition():
    r = random.Random(1)
    for order in (0, 1, 2, 4, 6):
        train = [bytes(r.choices(b"abcd ", k=r.randrange(0, 60))) for _ in range(12)]
        texts = [bytes(r.choices(b"abcde \xff\x00", k=r.randrange(0, 40))) for _ in range(20)] + [b"", b"abc"]
        keys, counts = ppm.merge_counts([ppm.window_counts(train[:5], order), ppm.window_counts(train[5:], order)])
        got = ppm.Scorer([ppm.Model(ppm.levels_of(keys, counts, order))], order, slots=6).bits(texts, block=17)[:, 0]
        assert np.allclose(got, [brute(train, order, t) for t in texts])


def test_probabilities_sum_to_one():
    keys, counts = ppm.window_counts([b"abracadabra", b"abc"], 3)
    model = ppm.Model(ppm.levels_of(keys, counts, 3))
    for context in (b"abr", b"xyz", b"cad"):
        base = 0
        for s in context:
            base = base << ppm.BITS | s
        every = np.array([base << ppm.BITS | s for s in range(ppm.SYMBOLS)])
        assert abs(np.exp2(-model.bits(every)).sum() - 1) < 1e-9


def test_empty_model():
    assert np.allclose(ppm.Scorer([ppm.Model(ppm.levels_of(*ppm.window_counts([], 2), 2))], 2).bits([b"a"]), 2 * math.log2(257))


def test_probabilities_of_a_pruned_tree_sum_to_one():
    levels = ppm.levels_of(*ppm.window_counts([b"abracadabra abracadabra", b"abcabdabe"], 3), 3)
    pruned = [(k[c >= least], c[c >= least]) for (k, c), least in zip(levels, (0, 0, 0, 2), strict=True)]
    model = ppm.Model(pruned)
    for context in (b"abr", b"xab", b"cad"):
        base = 0
        for s in context:
            base = base << ppm.BITS | s
        every = np.array([base << ppm.BITS | s for s in range(ppm.SYMBOLS)])
        assert abs(np.exp2(-model.bits(every)).sum() - 1) < 1e-9
