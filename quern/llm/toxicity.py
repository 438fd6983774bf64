"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into words (white space; A-Z lower-cased, ASCII punctuation taken
out).  A word of over RUN bytes is read as runs of so many bytes, each a position
of its own, so that a text without spaces has windows too.  A word's input is its own vector, if the training sample holds the word
often enough, beside the mean of vectors of its hashed character trigrams, so
that unseen inflections of a seen word are near it.  Two gated recurrent layers
read a window of ``WIDTH`` words forwards and backwards; attention weighs their
states; a linear unit gives the window's logit.  Windows begin every ``STRIDE``
words, so neighbours overlap, and all windows of a text are scored: the text's
score is the logistic of the largest logit.

Training (backpropagation through time, Adam) runs on the driver over a bounded
sample: for each class the labelled documents with the least hash of their id
(cut by a bound on the hash before any shuffle), at most ``per_class`` toxic and twice as many others, of at most
``max_chars`` characters each.  Windows of a toxic text first all count as
toxic, and later only those that the network itself ranks in the text's upper
half.  Only the text enters a score.

Null and empty texts score 0.  Without labelled examples of both classes every
text scores 0.  Texts of any length are scored whole.  Repeated labels of one id
count once, as toxic if any says so; null labels and ids aren't learned from.
Each row gives one row, null ids stay null (ids are whole numbers), an empty
table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, keep_rows, least_hashed, table, texts

WIDTH, STRIDE = 48, 32
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
BUCKETS = 1 << 13
VOCABULARY = 20_000
REMEMBERED = 100_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
RUN = 64
_PUNCTUATION = string.punctuation.encode()


def split_words(text: bytes) -> list[bytes]:
    words = text.lower().translate(None, _PUNCTUATION).split()
    if max(map(len, words), default=0) <= RUN:
        return words
    return [w[k : k + RUN] for w in words for k in range(0, len(w), RUN)]


def trigrams(word: bytes) -> list[int]:
    w = b"<" + word + b">"
    return [zlib.crc32(w[k : k + 3]) % BUCKETS for k in range(max(1, len(w) - 2))]


def windows(n: int) -> range:
    """Starts of the windows that cover n words, each but the first beginning within its forerunner."""
    return range(0, max(1, n - (WIDTH - STRIDE)), STRIDE)


def scatter(rows: int, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum the rows of values that share an index."""
    out = np.zeros((rows, values.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        at = index[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters p; the vocabulary maps a word to its row of p["word"] (0: none)."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *shape, s=0.3: (r.standard_normal(shape) * s).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocabulary = vocabulary
        self.p = {"word": f(len(vocabulary) + 1, WORD_DIM, s=0.1), "char": f(BUCKETS, CHAR_DIM, s=0.1), "wx": f(2, d, 3 * h), "wb": np.zeros((2, 1, 3 * h), np.float32), "uh": f(2, h, 3 * h), "ta": f(2 * h, ATTENTION), "va": f(ATTENTION), "uo": f(2 * h), "bo": np.zeros(1, np.float32)}
        self.p["word"][0] = 0

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary row of each word; trigram buckets, flat; the word that each bucket belongs to."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        grams = [trigrams(w) for w in words]
        owner = np.repeat(np.arange(len(words)), [len(g) for g in grams])
        return ids, np.fromiter((b for g in grams for b in g), np.int64, len(owner)), owner

    def inputs(self, feats) -> np.ndarray:
        ids, grams, owner = feats
        count = np.bincount(owner, minlength=len(ids)).astype(np.float32)
        total = scatter(len(ids), owner, self.p["char"][grams])
        return np.concatenate([self.p["word"][ids], total / count[:, None]], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """The inputs' part of the gates, (directions, words + 1, 3 hidden); the last row is padding, which holds the state."""
        g = np.matmul(x[None], self.p["wx"]) + self.p["wb"]
        pad = np.zeros((2, 1, 3 * HIDDEN), np.float32)
        pad[:, :, :HIDDEN] = 30
        return np.concatenate([g, pad], axis=1).astype(np.float32)

    def forward(self, g: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows; ids (windows, WIDTH) index the rows of g, the last row being padding."""
        n, h = len(ids), HIDDEN
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((WIDTH, n, 2 * h), np.float32)
        trail = []
        uh = self.p["uh"]
        for t in range(WIDTH):
            x = np.stack([g[0].take(ids[:, t], axis=0), g[1].take(ids[:, WIDTH - 1 - t], axis=0)])
            u = np.matmul(state, uh)
            zr = sigmoid(x[:, :, : 2 * h] + u[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            c = np.tanh(x[:, :, 2 * h :] + r * u[:, :, 2 * h :])
            new = c + z * (state - c)
            if keep:
                trail.append((state, z, r, c, u[:, :, 2 * h :]))
            state = new
            states[t, :, :h] = new[0]
            states[WIDTH - 1 - t, :, h:] = new[1]
        a = np.tanh(states @ self.p["ta"])
        e = a @ self.p["va"] + np.where(ids.T == g.shape[1] - 1, np.float32(-1e9), np.float32(0))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        logit = pooled @ self.p["uo"] + self.p["bo"]
        return (logit, (states, a, alpha, pooled, trail)) if keep else logit

    def gradients(self, x: np.ndarray, feats, ids: np.ndarray, y: np.ndarray, weight: np.ndarray):
        p, h, grad = self.p, HIDDEN, {}
        g = self.gates(x)
        logit, (states, a, alpha, pooled, trail) = self.forward(g, ids, keep=True)
        d = ((sigmoid(logit) - y) * weight / max(weight.sum(), 1)).astype(np.float32)
        grad["uo"], grad["bo"] = pooled.T @ d, d.sum(keepdims=True)
        dpool = d[:, None] * p["uo"]
        dalpha = np.einsum("nh,tnh->tn", dpool, states)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        dstates = alpha[:, :, None] * dpool[None]
        grad["va"] = np.einsum("tn,tna->a", de, a)
        da = de[:, :, None] * p["va"] * (1 - a * a)
        grad["ta"] = np.einsum("tnh,tna->ha", states, da, optimize=True)
        dstates += da @ p["ta"].T
        dxs = np.empty((2, WIDTH, len(ids), 3 * h), np.float32)
        grad["uh"] = np.zeros_like(p["uh"])
        dh = np.zeros((2, len(ids), h), np.float32)
        ut = p["uh"].transpose(0, 2, 1)
        for t in reversed(range(WIDTH)):
            prev, z, r, c, un = trail[t]
            dh[0] += dstates[t, :, :h]
            dh[1] += dstates[WIDTH - 1 - t, :, h:]
            dz = dh * (prev - c) * z * (1 - z)
            dc = dh * (1 - z) * (1 - c * c)
            dr = dc * un * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], axis=2)
            dx = np.concatenate([dz, dr, dc], axis=2)
            grad["uh"] += np.matmul(prev.transpose(0, 2, 1), du)
            dh = dh * z + np.matmul(du, ut)
            dxs[0, t], dxs[1, WIDTH - 1 - t] = dx
        dg = np.stack([scatter(g.shape[1], ids.T.ravel(), d.reshape(-1, 3 * h)) for d in dxs])[:, :-1]
        grad["wb"] = dg.sum(axis=1, keepdims=True)
        grad["wx"] = np.matmul(x.T[None], dg)
        dxin = np.matmul(dg, p["wx"].transpose(0, 2, 1)).sum(axis=0)
        words, grams, owner = feats
        grad["word"] = scatter(len(p["word"]), words, dxin[:, :WORD_DIM])
        grad["word"][0] = 0
        count = np.bincount(owner, minlength=len(words)).astype(np.float32)
        grad["char"] = scatter(len(p["char"]), grams, (dxin[:, WORD_DIM:] / count[:, None])[owner])
        return logit, grad


def cut(ids: np.ndarray, pad: int) -> np.ndarray:
    """The windows of one text's word numbers, the last filled up with padding."""
    starts = windows(len(ids))
    full = np.full(starts[-1] + WIDTH, pad, np.int64)
    full[: len(ids)] = ids
    return full[np.asarray(starts)[:, None] + np.arange(WIDTH)]


def log_odds(with_toxic: np.ndarray, with_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Smoothed log odds of a feature's presence, shrunk where few texts hold it."""
    rate = lambda x, n: np.log((x + 0.5) / (n - x + 0.5 + 1e-9))
    seen = with_toxic + with_clean
    return ((rate(with_toxic, toxic) - rate(with_clean, clean)) * seen / (seen + 8)).astype(np.float32)


def fit(toxic: list[bytes], clean: list[bytes], epochs: int = 6, batch: int = 256, rate: float = 0.02, least_steps: int = 240, seed: int = 7) -> Network:
    """Every fourth text sets the bias alone: where toxic and clean texts of it part best is a score of one half."""
    docs = [split_words(t) for t in [*toxic, *clean]]
    label = np.array([1] * len(toxic) + [0] * len(clean), np.float32)
    aside = np.arange(len(docs)) % 4 == 3
    learns = [k for k in range(len(docs)) if not aside[k]]
    parts = [[set(docs[k]) for k in learns if label[k] == y] for y in (1, 0)]
    counts = [Counter(w for d in part for w in d) for part in parts]
    both = counts[0] + counts[1]
    vocabulary = {w: k for k, (w, c) in enumerate(sorted(both.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY], 1) if c >= 4}
    net = Network(vocabulary, seed)
    odds = lambda keys, c: log_odds(*(np.array([x[k] for k in keys], float) for x in c), *map(len, parts))
    if vocabulary:
        net.p["word"][1:, 0] = odds(list(vocabulary), counts)
    grams = [Counter(g for d in part for g in {g for w in d for g in trigrams(w)}) for part in parts]
    net.p["char"][:, 0] = 2 * odds(range(BUCKETS), grams)
    every = {w: k for k, w in enumerate(sorted({w for d in docs for w in d}))}
    feats_all = net.features(list(every))
    bounds = np.searchsorted(feats_all[2], np.arange(len(every) + 1))
    wins = [cut(np.fromiter((every[x] for x in d), np.int64, len(d)), len(every)) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(w) for w in wins])
    wins = np.concatenate(wins)
    y = label[owner]
    size = np.bincount(owner, minlength=len(docs))
    logits = np.zeros(len(wins), np.float32)

    def read(at: np.ndarray):
        uniq, inverse = np.unique(np.append(wins[at].ravel(), len(every)), return_inverse=True)  # padding has the largest number, so the last row
        real = uniq[:-1]
        flat = np.concatenate([np.arange(bounds[w], bounds[w + 1]) for w in real]) if len(real) else np.zeros(0, np.int64)
        return (feats_all[0][real], feats_all[1][flat], np.repeat(np.arange(len(real)), bounds[real + 1] - bounds[real])), inverse[:-1].reshape(len(at), WIDTH)

    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    r, step = np.random.default_rng(seed), 0
    epochs = max(epochs, -(-least_steps * batch // max(1, len(wins))))
    for epoch in range(epochs):
        use = ~aside[owner]
        if epoch >= 1:  # of a toxic text, the upper half of its windows
            order = np.lexsort((-logits, owner))
            rank = np.empty(len(wins), np.int64)
            rank[order] = np.arange(len(wins)) - np.repeat(np.cumsum(size) - size, size)
            use &= (y == 0) | (rank < np.maximum(1, size[owner] // 2))
        chosen = r.permutation(np.flatnonzero(use))
        for k in range(0, len(chosen), batch):
            at = chosen[k : k + batch]
            feats, ids = read(at)
            if not len(feats[0]):
                continue
            logits[at], grad = net.gradients(net.inputs(feats), feats, ids, y[at], np.ones(len(at), np.float32))
            step += 1
            for name, gr in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * gr
                s[name] = 0.99 * s[name] + 0.01 * gr * gr
                lr = rate * (1 - epoch / (epochs + 1)) * (0.3 if name in ("word", "char") else 1)
                net.p[name] -= (lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    last = np.flatnonzero(aside[owner])
    top = np.full(len(docs), -np.inf, np.float32)
    for k in range(0, len(last), 2048):
        at = last[k : k + 2048]
        feats, ids = read(at)
        np.maximum.at(top, owner[at], net.forward(net.gates(net.inputs(feats)), ids))
    net.p["bo"] -= np.float32(parting(top[aside & (label == 1)], top[aside & (label == 0)]))
    return net


def parting(toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit with the least sum of both error rates between two samples; the middle of its gap."""
    if not len(toxic) or not len(clean):
        return 0.0
    cuts = np.sort(np.concatenate([toxic, clean]))
    middle = (cuts[1:] + cuts[:-1]) / 2
    errors = (toxic[None] < middle[:, None]).mean(axis=1) + (clean[None] >= middle[:, None]).mean(axis=1)
    gap = np.where(errors <= errors.min() + 1e-9, cuts[1:] - cuts[:-1], -1)
    return float(middle[gap.argmax()])


def train(docs: DataFrame, labels: DataFrame, learn, per_class: int = 300, max_chars: int = 20_000) -> Network | None:
    """docs: (doc_id, text); labels: (doc_id, toxic).  None without examples of both classes."""
    known = labels.where("doc_id is not null and toxic is not null").where(learn).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    toxic = {i: y for y, i in least_hashed(known, "toxic", lambda y: per_class if y else 2 * per_class)}  # at most three times per_class
    if len(set(toxic.values())) < 2:
        return None
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isin(sorted(toxic))).where(F.length("text") <= max_chars).groupBy("doc_id").agg(F.min("text").alias("text")).collect()  # of repeated ids, the least text
    found = sorted((r["doc_id"], r["text"].encode()) for r in rows)
    by = [[t for i, t in found if toxic[i] == k] for k in (1, 0)]
    return fit(*by) if all(by) else None


class Scorer:
    """Scores texts; it remembers the gates of words it has met, in two generations of half REMEMBERED words each.

    When one is full, it replaces the one before it.  Words met again come along, so frequent words are computed once.
    """

    def __init__(self, net: Network | None):
        self.net = net
        self.known, self.gates = self.before = {}, np.zeros((2, 1, 3 * HIDDEN), np.float32)  # the last row is padding's

    def learn(self, some: list[list[bytes]]) -> None:
        new = list({w for ws in some for w in ws if w not in self.known})
        if len(self.known) + len(new) > REMEMBERED // 2:
            self.before, self.known, self.gates = (self.known, self.gates), {}, self.gates[:, :1]
            new = list({w for ws in some for w in ws})
        start, end = len(self.known), len(self.known) + len(new)
        if self.gates.shape[1] <= end:
            rows = np.zeros((2, max(end, min(2 * end, REMEMBERED // 2)) + 1, 3 * HIDDEN), np.float32)
            rows[:, :start] = self.gates[:, :start]
            rows[:, -1, :HIDDEN] = 30
            self.gates = rows
        at = np.fromiter((self.before[0].get(w, -1) for w in new), np.int64, len(new))
        rows = self.gates[:, start:end]
        rows[:, at >= 0] = self.before[1][:, at[at >= 0]]
        if unseen := [w for w, k in zip(new, at.tolist()) if k < 0]:
            rows[:, at < 0] = self.net.gates(self.net.inputs(self.net.features(unseen)))[:, :-1]
        self.known.update(zip(new, range(start, end)))

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        result = np.zeros(len(bodies))
        for k in range(0, len(bodies) if self.net else 0, 128):
            some = [split_words(b) for b in bodies[k : k + 128]]
            at = [n for n, ws in enumerate(some) if ws]
            if not at:
                continue
            self.learn(some)
            pad = self.gates.shape[1] - 1
            wins = [cut(np.fromiter(map(self.known.__getitem__, some[n]), np.int64, len(some[n])), pad) for n in at]
            every = np.concatenate(wins)
            logit = np.concatenate([self.net.forward(self.gates, every[x : x + 2048]) for x in range(0, len(every), 2048)])
            starts = np.concatenate([[0], np.cumsum([len(w) for w in wins])[:-1]])
            result[np.array(at) + k] = sigmoid(np.maximum.reduceat(logit, starts))
        return result


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs: (doc_id, held_out, text).  Adds score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by VOCABULARY and BUCKETS

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in rows:
            result = scorer.scores(texts(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(result), pa.array((result >= 0.5).astype(np.int32))], schema=SCHEMA)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, net: Network | None, most: float = 0.5) -> DataFrame:
    """The rows that score below ``most``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def judge():
        scorer = Scorer(shared.value)
        return lambda bodies: scorer.scores(bodies) < most

    return keep_rows(docs, judge)


def judge(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, **sizes) -> DataFrame:
    """Train on the labels whose crc32 remainder differs, and score all documents."""
    net = train(docs, labels, ~held_out("doc_id", modulus, remainder), **sizes)
    return score(docs.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "text"), net)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
