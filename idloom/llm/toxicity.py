"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins its own vector (words of the training sample; others share one) and the mean of the vectors of its
character sequences of 3 to 5. Two gated recurrent layers, one in each direction, read windows of WINDOW words that overlap by a quarter;
attention pools a window's states into one logit. All windows of a text are scored, and its score is that of the
highest one, in training as in use (the text's label counts for its highest windows).

Learning uses a bounded sample: about `sample` labelled documents by label, chosen by a hash of the id, with whole texts.

Defined results: null and empty texts and texts without letters have score 0. Without learned rows of both labels every score is
0. Null labels aren't learned from; of rows that share an id the first text in order is; a null id belongs to no fold and has no label. Rows repeat as in the input; further columns
are ignored. Equal windows score the same, so ties don't matter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm.common import in_fold, map_texts, table, token, worker_state

WINDOW, STRIDE = 32, 24
#: Sizes: word vector, character vector, state, attention, words and rows for character sequences.
WORD, CHAR, STATE, ATTENTION, VOCABULARY, GRAMS = 8, 8, 8, 8, 20_000, 1 << 15
#: Learned documents of label 0 and of label 1, on average.
SAMPLE, THRESHOLD = (2400, 800), 0.7
EPOCHS, STEPS, BATCH, RATE, TABLE_RATE = 6, 120, 64, 0.02, 1.0
#: Documents of the sample that a word must be in to get a vector of its own.
LEAST = 4
#: Words that a worker keeps before it starts anew.
TABLE = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")
_SEED, _RANGE = 19, 1 << 30
_f = np.float32


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def window_starts(n: int) -> list[int]:
    """Windows that cover n words; the last one may be short."""
    return list(range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)) if n else []


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all sequences of 3 to 5 characters of the words between border marks, and where each word's begin."""
    text = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(sizes) - sizes
    rows, owner = [], []
    for k in (3, 4, 5):
        n = np.maximum(sizes - k + 1, 0)
        own = np.repeat(np.arange(len(words)), n)
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        mixed = np.zeros(len(at), np.uint64)
        for j in range(k):
            mixed = (mixed + text[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        rows.append((mixed >> np.uint64(40)).astype(np.int64) % GRAMS)
        owner.append(own)
    order = np.argsort(np.concatenate(owner), kind="stable")
    total = np.maximum(sizes - 2, 0) + np.maximum(sizes - 3, 0) + np.maximum(sizes - 4, 0)
    return np.concatenate(rows)[order], np.cumsum(total) - total


def clearness(with_it: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How clearly texts of label 1 have something more often than those of label 0: in deviations, over 4, within 1."""
    share = with_it / size
    spread = np.sqrt((share * (1 - share) / size).sum(axis=1) + (1 / size**2).sum())
    return (np.clip((share[:, 1] - share[:, 0]) / spread, -4, 4) / 4).astype(_f)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sigmoid_in_place(x: np.ndarray) -> None:
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


class Network:
    """The parameters, by name; directions are the first axis of what both have."""

    def __init__(self, vocabulary: list[str], seed: int = 1):
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: r.normal(0, scale, shape).astype(_f)
        inputs = WORD + CHAR
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: all other words
        self.p = {
            "word": draw(len(vocabulary) + 1, WORD, scale=0.05),
            "char": draw(GRAMS, CHAR, scale=0.05),
            "w": draw(2, inputs, 3 * STATE, scale=inputs**-0.5),
            "b": np.zeros((2, 1, 3 * STATE), _f),
            "u": draw(2, STATE, 3 * STATE, scale=STATE**-0.5),
            "wa": draw(2 * STATE, ATTENTION, scale=(2 * STATE) ** -0.5),
            "ba": np.zeros(ATTENTION, _f),
            "va": draw(ATTENTION, scale=1.0),
            "wo": draw(2 * STATE, scale=(2 * STATE) ** -0.5),
            "bo": np.zeros(1, _f),
        }

    def inputs(self, word: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Input vectors of words, given their word rows and character rows."""
        n = np.diff(np.concatenate((first, [len(grams)]))).astype(_f)
        return np.concatenate((self.p["word"][word], np.add.reduceat(self.p["char"][grams], first, axis=0) / n[:, None]), axis=1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        return np.matmul(x[None], self.p["w"]) + self.p["b"]

    def forward(self, projected: np.ndarray, rows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows: rows of the projected words, -1 where a short window has none."""
        p, (n, size) = self.p, rows.shape
        there = rows >= 0
        both = np.stack((rows, rows[:, ::-1]))
        mask = (both >= 0).astype(_f)
        full = bool(there.all())
        every = np.empty((2, size, n, STATE), _f)
        h = np.zeros((2, n, STATE), _f)
        flat = np.concatenate((projected[0], projected[1]))
        shift = np.array([0, len(projected[0])])[:, None]
        for t in range(size):
            x = flat[np.maximum(both[:, :, t], 0) + shift]
            g = np.matmul(h, p["u"])
            gates = x[..., : 2 * STATE] + g[..., : 2 * STATE]
            sigmoid_in_place(gates)
            z, r = gates[..., :STATE], gates[..., STATE:]
            c = np.tanh(x[..., 2 * STATE :] + r * g[..., 2 * STATE :])
            if keep is not None:
                keep.append((h, z, r, c, g[..., 2 * STATE :], mask[:, :, t, None]))
            new = (1 - z) * (c - h)
            if not full:
                new *= mask[:, :, t, None]
            new += h
            h = every[:, t] = new
        states = np.concatenate((every[0], every[1, ::-1]), axis=2).transpose(1, 0, 2)  # window, place, both states
        hidden = np.tanh(states @ p["wa"] + p["ba"])
        weight = np.where(there, hidden @ p["va"], -np.inf)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = (weight[..., None] * states).sum(axis=1)
        if keep is not None:
            keep.append((states, hidden, weight, pooled))
        return pooled @ p["wo"] + p["bo"]

    def backward(self, d: np.ndarray, keep: list, rows: np.ndarray, n_words: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients from those of the logits; the second part is that of the projected words."""
        p, g = self.p, {}
        states, hidden, weight, pooled = keep.pop()
        g["wo"], g["bo"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["wo"]
        dw = (states * dp[:, None]).sum(axis=2)
        ds = weight[..., None] * dp[:, None]
        dl = weight * (dw - (weight * dw).sum(axis=1, keepdims=True))
        g["va"] = np.einsum("nt,nta->a", dl, hidden)
        da = dl[..., None] * p["va"] * (1 - hidden**2)
        g["wa"], g["ba"] = np.einsum("nts,nta->sa", states, da), da.sum(axis=(0, 1))
        ds = ds + da @ p["wa"].T
        size = rows.shape[1]
        every = np.stack((ds[..., :STATE], ds[:, ::-1, STATE:]))
        both = np.stack((rows, rows[:, ::-1]))
        g["u"] = np.zeros_like(p["u"])
        dx = np.zeros((2, n_words, 3 * STATE), _f)
        gates = np.empty((2, *rows.shape, 3 * STATE), _f)
        dh = np.zeros((2, len(rows), STATE), _f)
        for t in range(size - 1, -1, -1):
            h, z, r, c, un, m = keep.pop()
            dh = dh + every[:, :, t]
            dz = m * dh * (h - c) * z * (1 - z)
            dc = m * dh * (1 - z) * (1 - c**2)
            dr = dc * un * r * (1 - r)
            gate = np.concatenate((dz, dr, dc * r), axis=2)
            g["u"] += np.matmul(h.transpose(0, 2, 1), gate)
            dh = dh * (1 - m * (1 - z)) + np.matmul(gate, p["u"].transpose(0, 2, 1))
            own = np.concatenate((dz, dr, dc), axis=2)
            gates[:, :, t] = own
        for k in (0, 1):
            some = both[k].ravel()
            dx[k] = summed(some[some >= 0], gates[k].reshape(-1, 3 * STATE)[some >= 0], n_words)
        return g, dx


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows at each of n places."""
    out = np.zeros((n, rows.shape[1]), _f)
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    out[places] = np.add.reduceat(rows[order], first, axis=0)
    return out


def train(texts: list[str], labels: list[int], seed: int = 1) -> Network | None:
    """None without texts of both labels."""
    number: dict[str, int] = {}
    docs = []
    for t, y in zip(texts, labels, strict=True):
        if w := words_of(t):
            docs.append((np.array([number.setdefault(x, len(number)) for x in w], np.int32), y))
    if len({y for _, y in docs}) < 2:
        return None
    words = list(number)
    with_word = np.zeros((len(words), 2), np.int64)
    for ids, y in docs:
        with_word[np.unique(ids), y] += 1
    often = np.flatnonzero(with_word.sum(axis=1) >= LEAST).tolist()
    often.sort(key=lambda i: (-with_word[i].sum(), words[i]))
    often = often[:VOCABULARY]
    net = Network([words[i] for i in often], seed)
    size = np.array([sum(1 - y for _, y in docs), sum(y for _, y in docs)], np.float64)
    own = np.array([net.vocabulary.get(x, 0) for x in words])
    grams, first = gram_rows(words)
    ends = np.concatenate((first[1:], [len(grams)]))
    # the first components start at how clearly the labels differ
    net.p["word"][1:, 0] += clearness(with_word[often].reshape(-1, 2), size)
    with_gram = np.zeros((GRAMS, 2))
    for ids, y in docs:
        with_gram[np.unique(np.concatenate([grams[first[i] : ends[i]] for i in np.unique(ids)])), y] += 1
    net.p["char"][:, 0] += 2 * clearness(with_gram, size)
    rows, doc = [], []
    for i, (ids, _) in enumerate(docs):
        for a in window_starts(len(ids)):
            w = ids[a : a + WINDOW]
            rows.append(w if len(w) == WINDOW else np.concatenate((w, np.full(WINDOW - len(w), -1, np.int32))))
            doc.append(i)
    rows, doc = np.array(rows), np.array(doc)
    begin = np.searchsorted(doc, np.arange(len(docs) + 1))
    y = np.array([y for _, y in docs], _f)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(_f)
    r = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, epochs = 0, max(EPOCHS, -(-STEPS // -(-len(docs) // BATCH)))
    for epoch in range(epochs):
        projected = net.projected(net.inputs(own, grams, first))
        score = np.concatenate([net.forward(projected, rows[i : i + 4096]) for i in range(0, len(rows), 4096)])
        # the highest windows of each text; while nothing is learned yet, others as well
        picked = [a + np.argsort(-score[a:b], kind="stable")[:2] for a, b in zip(begin, begin[1:], strict=False)]
        if epoch < 3:
            picked = [np.unique(np.concatenate((q, r.integers(a, b, 3)))) for q, a, b in zip(picked, begin, begin[1:], strict=False)]
        else:
            picked = [q[:1] if y[i] else q for i, q in enumerate(picked)]
        order = r.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            window = np.concatenate([picked[i] for i in order[at : at + BATCH]])
            of, some = np.unique(rows[window], return_inverse=True)
            if of[0] < 0:
                of, some = of[1:], some - 1
            some = some.reshape(len(window), WINDOW)
            spans = [np.arange(first[i], ends[i]) for i in of]
            gram, gram_first = grams[np.concatenate(spans)], np.cumsum([0, *map(len, spans)])[:-1]
            known = np.where(r.random(len(of)) < 0.1, 0, own[of])  # some words by their characters alone
            x = net.inputs(known, gram, gram_first)
            keep: list = []
            logit = net.forward(net.projected(x), some, keep)
            d = ((sigmoid(logit) - y[doc[window]]) * share[doc[window]] / len(window)).astype(_f)
            g, dx = net.backward(d, keep, some, len(of))
            g["w"] = np.matmul(x.T[None], dx)
            g["b"] = dx.sum(axis=1, keepdims=True)
            di = np.matmul(dx, net.p["w"].transpose(0, 2, 1)).sum(axis=0)
            g["word"] = summed(known, di[:, :WORD], len(net.p["word"]))
            sizes = np.diff(np.concatenate((gram_first, [len(gram)])))
            g["char"] = summed(gram, np.repeat(di[:, WORD:] / sizes[:, None], sizes, axis=0), GRAMS)
            step += 1
            pace = max(0.05, 1 - step / (epochs * -(-len(docs) // BATCH)))
            for k, v in net.p.items():
                if k in ("word", "char"):  # plain steps, so that rare words don't move as far as common ones
                    v -= pace * TABLE_RATE * g[k]
                    continue
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.01 * (g[k] ** 2 - square[k])
                v -= pace * RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    return net


class Scorer:
    """Scores texts; keeps the projected inputs of words."""

    def __init__(self, net: Network):
        self.net = net
        self._anew()

    def _anew(self) -> None:
        self.number: dict[str, int] = {}
        self.projected = np.zeros((2, 1 << 16, 3 * STATE), _f)
        self.used = 0

    def rows(self, words: list[str]) -> np.ndarray:
        if self.used > TABLE:
            self._anew()
        number = self.number
        fresh = [w for w in dict.fromkeys(words) if w not in number]
        while self.used + len(fresh) > self.projected.shape[1]:
            self.projected = np.concatenate((self.projected, np.zeros_like(self.projected)), axis=1)
        for i in range(0, len(fresh), 1 << 14):
            part = fresh[i : i + (1 << 14)]
            own = np.fromiter((self.net.vocabulary.get(w, 0) for w in part), np.int64, len(part))
            self.projected[:, self.used : self.used + len(part)] = self.net.projected(self.net.inputs(own, *gram_rows(part)))
            number.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        sizes = [len(w) for w in split]
        ids = np.concatenate((self.rows([w for words in split for w in words]), np.full(WINDOW, -1)))
        first = np.cumsum([0, *sizes])
        starts = [window_starts(n) for n in sizes]
        doc = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        at = np.array([a for s in starts for a in s], np.int64)
        out = np.full(len(texts), -np.inf)
        place, last = first[doc] + at, first[doc + 1]
        short = place + WINDOW > last
        for some in (np.flatnonzero(~short), np.flatnonzero(short)):
            for i in range(0, len(some), 4096):
                k = some[i : i + 4096]
                where = place[k, None] + np.arange(WINDOW)
                np.maximum.at(out, doc[k], self.net.forward(self.projected, np.where(where < last[k, None], ids[where], -1)))
        return np.where(np.isinf(out), 0.0, sigmoid(out.clip(-30, 30)))


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: tuple[int, int] = SAMPLE) -> Network | None:
    """may_learn: a condition on the labels' ids."""
    marked = labels.filter(may_learn & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("i"), F.col(label).alias("y"))
    share = {r["y"]: min(1.0, sample[r["y"]] / r["n"]) for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return None
    limit = F.when(F.col("y") == 1, int(share[1] * _RANGE)).otherwise(int(share[0] * _RANGE))
    chosen = marked.filter(F.pmod(F.xxhash64(F.lit(_SEED), F.col("i").cast("string")), F.lit(_RANGE)) < limit)
    # the chosen labels are a bounded sample, so they go to where the texts are
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min("t").alias("t")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["i"], r["y"]))
    return train([r["t"] for r in rows], [r["y"] for r in rows])


def scored(docs: DataFrame, net: Network | None, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns to keep, score and predicted."""
    shared, own = docs.sparkSession.sparkContext.broadcast(net), token()
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("__text").to_pylist()
        scores = worker_state(own, lambda: Scorer(shared.value)).scores(texts) if shared.value else np.zeros(len(texts))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], names=[*keep, "score"])

    return map_texts(docs.select(*keep, F.col(text).alias("__text")), "__text", run, f"{fields}score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs, held = table(spark, sf_dir, "documents"), in_fold("doc_id", 3, 1)
    net = learn(docs, table(spark, sf_dir, "labels"), F.col("doc_id").isNotNull() & ~held)
    return scored(docs.select("doc_id", held.alias("held_out"), "text"), net, ["doc_id", "held_out"])


QUERIES = {"op4_toxicity": op4}
SQL: dict[str, str] = {}
