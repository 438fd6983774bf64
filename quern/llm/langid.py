"""Language identification by segmentation-marginalised unigrams.

Over a fixed public vocabulary of pieces, each language has a probability for
each piece.  The probability of a word is the sum, over all its segmentations
into pieces, of the product of their probabilities; a forward algorithm adds it
up in one pass:  a(0) = 1,  a(j) = sum over pieces that end at j of a(i) p(piece).

The piece probabilities are fitted by expectation maximisation (forward and
backward passes give each piece's expected count) on a bounded sample of
labelled documents: for each language the ``per_language`` documents with the
smallest hash of their id, of at most ``max_chars`` characters each.  Language,
source and id play no part in a prediction.

A text's words (runs of letters with their marks, lower-cased, with the word
mark U+2581 in front) are scored independently under each language; the posterior
with a uniform prior over the languages gives ``lang_pred`` (ties: the first in
sorted order) and ``score``, its probability.  A character that no piece covers
has one fixed probability in every language.  The passes are rescaled every
STEP characters, so words of any length are scored whole.

``keep`` also asks for evidence that a posterior among the learned languages
can't give: the text's log probability for each character, under its language,
must not lie more than ``margin`` below that of the ``quantile`` of the
training sample's own texts, as that of an unlearned language or of random
letters does.

Null texts, and texts without a letter, are ``und`` with score 0.  If nothing
labelled can be learned from, every text is ``und``.  Of sampled rows that share
language and id, the least text is learned from.  Each row gives one row;
repeated and null ids are kept; ids are whole numbers; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, held_out, keep_rows, least_hashed, pieces_of, table, texts

MARK = "▁"
STEP = 16  # characters between two rescalings
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
REMEMBERED = 200_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def indexed(pieces: list[str]) -> dict[str, int]:
    """Piece to its number; -1 for what only begins a piece."""
    index: dict[str, int] = {}
    for p in pieces:
        for k in range(1, len(p)):
            index[p[:k]] = -1
    return index | {p: k for k, p in enumerate(pieces)}


def edges(words: list[str], index: dict[str, int], unknown: int) -> dict[int, list[tuple[int, np.ndarray]]]:
    """For words of one length: by end j, each start i with the piece number of characters i to j in each word, -1 if it is none.

    A character that isn't a piece gets the number ``unknown``.  A word is looked
    at no further from i once its characters begin no piece.
    """
    n, get = len(words[0]), index.get
    out: dict[int, list[tuple[int, np.ndarray]]] = {j: [] for j in range(1, n + 1)}
    for i in range(n):
        left, at = words, np.arange(len(words))
        for j in range(i + 1, n + 1):
            found = np.fromiter([get(w[i:j], -2) for w in left], np.int32, len(left))
            goes_on = found > -2
            ids = np.full(len(words), -1, np.int32)
            ids[at] = np.where(found < 0, unknown if j == i + 1 else -1, found)
            if (ids >= 0).any():
                out[j].append((i, ids))
            if not goes_on.all():
                at = at[goes_on]
                left = [w for w, g in zip(left, goes_on.tolist()) if g]
                if not left:
                    break
    return out


def passes(found: dict[int, list[tuple[int, np.ndarray]]], p: np.ndarray, rows: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """a(0..n) and their log scales, of shape (n + 1, rows, *p's columns): true values are a exp(scale).

    p: probabilities by piece number, the last (-1) zero.  Backwards, the sums over what follows each place.
    """
    n = len(found)
    a, scale = np.zeros((n + 1, rows, *p.shape[1:])), np.zeros((n + 1, rows, *p.shape[1:]))
    if backwards:
        back: dict[int, list[tuple[int, np.ndarray]]] = {i: [] for i in range(n)}
        for j, some in found.items():
            for i, ids in some:
                back[i].append((j, ids))
        order, into = range(n - 1, -1, -1), back
        a[n] = 1
    else:
        order, into = range(1, n + 1), found
        a[0] = 1
    s = np.zeros((rows, *p.shape[1:]))
    for step, j in enumerate(order, 1):
        for i, ids in into[j]:
            a[j] += a[i] * p[ids] if n <= STEP else a[i] * np.exp(scale[i] - s) * p[ids]
        scale[j] = s
        if step % STEP == 0:
            s = s + np.log(a[j])
            a[j], scale[j] = 1, s
    return a, scale


def forward(words: list[str], index: dict[str, int], table: np.ndarray) -> np.ndarray:
    """log P of words of one length under each language.  table: languages in columns; its last rows: unknown, none (0)."""
    a, scale = passes(edges(words, index, len(table) - 2), table, len(words))
    return np.log(a[-1]) + scale[-1]


def by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    yield from groups.items()


def word_scores(words: list[str], index: dict[str, int], table: np.ndarray) -> np.ndarray:
    """log P of each word (with its mark) under each language."""
    out = np.zeros((len(words), table.shape[1]))
    for n, at in by_length(words):
        size = max(1, 1_000_000 // (n * table.shape[1]))  # bounds the arrays of a pass
        for k in range(0, len(at), size):
            some = at[k : k + size]
            out[some] = forward([words[x] for x in some], index, table)
    return out


def split_words(text: str) -> list[str]:
    return [MARK + w for w in LETTERS.findall(text.lower())]


class Memory:
    """The scores of words that a worker has met, across its tasks, in two generations of half REMEMBERED words each.

    When one is full, it replaces the one before it.  Words met again come along, so frequent words are scored once.
    """

    def __init__(self, model: Model):
        self.model = model
        self.known, self.scores = self.before = {}, np.zeros((0, len(model.langs)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED // 2:
            self.before, self.known, self.scores = (self.known, self.scores), {}, self.scores[:0]
            new = list(words)
        if not new:
            return
        start, end = len(self.known), len(self.known) + len(new)
        if len(self.scores) < end:
            rows = np.zeros((max(end, min(2 * end, REMEMBERED // 2)), len(self.model.langs)))
            rows[:start] = self.scores[:start]
            self.scores = rows
        at = np.fromiter((self.before[0].get(w, -1) for w in new), np.int64, len(new))
        rows = self.scores[start:end]
        rows[at >= 0] = self.before[1][at[at >= 0]]
        rows[at < 0] = word_scores([w for w, k in zip(new, at.tolist()) if k < 0], self.model.index, self.model.table)
        self.known.update(zip(new, range(start, end)))

    def total(self, words: list[str]) -> np.ndarray:
        return self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)


class Model:
    """usual: the log probability for each character that nearly all sampled texts of a language reach."""

    def __init__(self, langs: list[str], pieces: list[str], probabilities: np.ndarray):
        self.langs, self.index, self.table = langs, indexed(pieces), probabilities
        self.usual = -np.inf

    @property
    def memory(self) -> Memory:
        if "_memory" not in self.__dict__:
            self._memory = Memory(self)
        return self._memory

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_memory"}


def fit(samples: dict[str, Counter], pieces: list[str], rounds: int = 3, alpha: float = 0.05) -> Model:
    """samples: language to word counts.  Expected piece counts come from forward and backward passes over all segmentations."""
    langs = sorted(samples)
    index = indexed(pieces)
    unknown = len(pieces)
    probabilities = np.zeros((len(pieces) + 2, len(langs)))
    for column, lang in enumerate(langs):
        words = sorted(samples[lang])
        counts = np.array([samples[lang][w] for w in words], float)
        groups = [(n, counts[at], edges([words[k] for k in at], index, unknown)) for n, at in by_length(words)]
        p = np.full(len(pieces) + 2, 1.0 / (len(pieces) + 1))
        p[-1] = 0
        for _ in range(rounds):
            expected = np.zeros(len(pieces) + 2)
            for n, c, found in groups:
                (a, up), (b, down) = passes(found, p, len(c)), passes(found, p, len(c), True)
                whole = np.log(a[n]) + up[n]
                for j, some in found.items():
                    for i, ids in some:
                        expected += np.bincount(ids % len(expected), a[i] * p[ids] * b[j] * np.exp(up[i] + down[j] - whole) * c, len(expected))
            expected[-1] = 0
            p = expected + alpha
            p[-1] = 0
            p /= p.sum()
        p[unknown] = 1e-6  # the same in every language
        probabilities[:, column] = p
    return Model(langs, pieces, probabilities)


def sample(docs: DataFrame, learn, per_language: int, max_chars: int) -> list[tuple[str, str]]:
    """(lang, text) of the bounded sample."""
    rows = docs.select("doc_id", "text", "lang").where(learn).where("doc_id is not null and lang is not null and text is not null").where(F.length("text") <= max_chars)
    ids = least_hashed(rows.select("lang", "doc_id"), "lang", lambda _: per_language)  # at most per_language for each language
    if not ids:
        return []
    found = rows.where(F.col("doc_id").isin(sorted({i for _, i in ids}))).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    wanted = set(ids)
    return sorted((r["lang"], r["text"]) for r in found if (r["lang"], r["doc_id"]) in wanted)


def train(docs: DataFrame, learn, vocabulary: str, per_language: int = 150, max_chars: int = 20_000, quantile: float = 0.01) -> Model:
    """docs: (doc_id, text, lang).  Fit on a sample of at most per_language documents of a language where ``learn`` holds."""
    words: dict[str, list[list[str]]] = {}
    for lang, text in sample(docs, learn, per_language, max_chars):
        words.setdefault(lang, []).append(split_words(text))
    some = {lang: Counter(w for ws in texts_ for w in ws) for lang, texts_ in words.items() if any(texts_)}
    model = fit(some, [p for p, _, _ in pieces_of(vocabulary)])
    rates = []
    for column, lang in enumerate(model.langs):
        model.memory.learn(set(some[lang]))
        rates += [model.memory.total(ws)[column] / sum(map(len, ws)) for ws in words[lang] if ws]
    model.usual = float(np.quantile(rates, quantile)) if rates else -np.inf
    return model


def verdicts(model: Model, bodies: list[bytes]) -> tuple[list[str], list[float], list[float]]:
    """The language and score of each text, and its log probability for each character."""
    lang, score, rate = [], [], []
    for k in range(0, len(bodies), 256):
        some = [split_words(b.decode("utf-8", "replace")) for b in bodies[k : k + 256]]
        if model.langs:
            model.memory.learn({w for ws in some for w in ws})
        for ws in some:
            if not ws or not model.langs:
                lang.append("und")
                score.append(0.0)
                rate.append(-np.inf)
                continue
            total = model.memory.total(ws)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            lang.append(model.langs[best])
            score.append(float(odds[best] / odds.sum()))
            rate.append(float(total[best]) / sum(map(len, ws)))
    return lang, score, rate


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs: (doc_id, held_out, text).  Adds lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary's size times the languages

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            lang, score, _ = verdicts(shared.value, texts(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=SCHEMA)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5, langs: frozenset[str] | None = None, margin: float = 2.0) -> DataFrame:
    """The rows whose language is identified with a score of ``least``, is one of ``langs`` where these are given, and fits the text (see above)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        def mask(bodies: list[bytes]) -> np.ndarray:
            fits = [x != "und" and s >= least and r >= shared.value.usual - margin and (langs is None or x in langs) for x, s, r in zip(*verdicts(shared.value, bodies))]
            return np.array(fits, bool)

        return mask

    return keep_rows(docs, judge)


def identify(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/piece_bpe_32k.model", modulus: int = 3, remainder: int = 1, **sizes) -> DataFrame:
    """Train on the documents whose crc32 remainder differs, and predict all of them."""
    out = held_out("doc_id", modulus, remainder)
    model = train(docs, ~out, vocabulary, **sizes)
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model)


def op5_langid(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
