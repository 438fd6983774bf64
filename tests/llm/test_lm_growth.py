import math
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa

from pyspark.core.broadcast import Broadcast
from pyspark.sql import functions as F

from quern.llm import lm


def test_filters_over_the_broadcast_lose_no_count(docs, awkward, monkeypatch):
    r = random.Random(9)
    rows = awkward + [(200 + i, " ".join(f"w{r.randrange(3000)} x{r.randrange(40)}" for _ in range(60)), "en") for i in range(120)]
    df = docs(rows)
    want = sorted(lm.score_all(df).collect(), key=str)
    for block, group in ((4 << 20, 16 << 20), (5000, 4000)):
        monkeypatch.setattr(lm, "BLOCK", block)
        monkeypatch.setattr(lm, "GROUP", group)
        got = sorted(lm.score_all(df, max_mb=0).collect(), key=str)
        assert len(got) == len(want) == len(rows)
        for a, b in zip(got, want):
            assert a["doc_id"] == b["doc_id"] and a["n_known"] == b["n_known"] and a["n_tokens"] == b["n_tokens"]
            assert abs(a["score"] - b["score"]) < 1e-6 and abs(a["base_score"] - b["base_score"]) < 1e-6
    assert lm.score_all(docs([]), max_mb=0).count() == 0


def test_filters_follow_the_counts(docs):
    """A filter's bits follow its counts, so a larger corpus has larger filters."""
    r = random.Random(4)
    some = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(2000)), "en") for i in range(120)]
    size = lambda rows, mb: lm.train(docs(rows).select("text"), mb)[1].agg(F.sum("size")).first()[0]
    assert size(some, 0) == size(some, 64) > 3 * size(some[:30], 0)


def exact_model(rows, quantised=False):
    """The model of the docstring by dictionaries: P(w | u), with exact counts or with counts as their levels give them."""
    from collections import Counter

    texts = [[*(t or "").encode().lower().split(), b""] for i, t, _ in rows if not is_out(i)]
    flat = [w for t in texts for w in t]
    words, pairs = Counter(flat), Counter((u, w) for t in texts for u, w in zip([b"", *t], t))
    followers, n = Counter(u for u, _ in pairs), len(flat)
    once, twice = (sum(c == k for c in words.values()) for k in (1, 2))
    p0, unseen = min(max(once, 1) / (n + 1), 0.5), max(once * once / (2 * twice) if twice else once * (once - 1) / 2, 1)

    def level(kind, x):
        return float(lm.value_of(kind, lm.levels(kind, np.array([x], float)))[0]) if x and quantised else x

    read = {w: level(1, c) for w, c in words.items()}
    whole = sum(read.values())

    def p(u, w):
        own = (1 - p0) * read[w] / whole if w in words else p0 / unseen
        if u not in words:
            return own
        left = lm.D / (level(3, 1e6 * words[u] / followers[u]) if quantised else words[u] / followers[u])
        pair = min(level(2, pairs[u, w]), read[u], read[w]) if (u, w) in pairs else 0
        return max(pair - lm.D, 0) / read[u] + left * own

    return p, words, unseen


def is_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_scores_are_those_of_a_distribution(docs):
    """Probabilities of all words and the unseen add up to 1, and the filter's scores are near those of exact counts."""
    r = random.Random(6)
    rows = [(i, " ".join(f"w{min(int(r.paretovariate(0.7)), 400)}" for _ in range(80)), "en") for i in range(150)]
    p, words, unseen = exact_model(rows)
    for u in [b"", b"w1", b"w7", b"unknown"]:
        assert math.isclose(sum(p(u, w) for w in words) + unseen * p(u, b"no such word"), 1, rel_tol=1e-9)
    model = lm.train(docs([x for x in rows if not is_out(x[0])]).select("text"))[0]
    every = lm.Hashes().of([w for w in words if w]).tolist() + [int(lm.END)]
    unknown = lm.Hashes().of([b"no such word"]).tolist()
    keys = np.array([*every, *unknown], np.uint64)
    values = model.word_values(keys)
    assert math.isclose(values[:-1, 1].sum() + model.unseen * values[-1, 1], 1, rel_tol=0.02)  # false hits
    for u in (b"w1", b"w3"):
        context = model.word_values(lm.Hashes().of([u]))
        given = [10 ** model.log10_of(model.filters[2].level(lm.pair_keys(lm.Hashes().of([u]), keys[k : k + 1])), values[k : k + 1], context)[0] for k in range(len(keys))]
        assert abs(sum(given[:-1]) + model.unseen * given[-1] - 1) < 0.15  # quantised counts, false hits
    q, off, hits = exact_model(rows, True)[0], [], []
    for x in lm.score_all(docs(rows)).collect():
        tokens = [*rows[x["doc_id"]][1].encode().split(), b""]
        exact, read = (sum(math.log10(f(u, w)) for u, w in zip([b"", *tokens], tokens)) for f in (p, q))
        hits.append((x["score"] - read) / len(tokens))
        off.append((x["score"] - exact) / len(tokens))
    assert np.mean(np.abs(hits) < 1e-6) > 0.4 and np.mean(np.abs(hits)) < 0.01  # false hits of the filter
    assert max(map(abs, off)) < 0.06 and abs(np.mean(off)) < 0.02  # quantised counts


def test_keys_that_come_again_are_probed_once(monkeypatch):
    """Remembered levels are the filter's, and a key of a high level isn't probed again, here or in the next texts."""
    r = random.Random(3)
    keys, values = np.array([r.randrange(1 << 64) for _ in range(4000)], np.uint64), np.array([1 + int(r.paretovariate(0.6)) % 10**6 for _ in range(4000)], float)
    shards = {s: lm.LogBloom.build(2, keys[keys >> np.uint64(60) == s], values[keys >> np.uint64(60) == s]) for s in range(16)}
    bloom, probed = lm.LogBloom(2, 4, shards), []
    plain = lm.LogBloom.level
    monkeypatch.setattr(lm.LogBloom, "level", lambda self, keys: probed.extend(keys.tolist()) or plain(self, keys))
    monkeypatch.setattr(lm, "TOGETHER", 100)
    pairs = lm.Remembered(bloom)
    for _ in range(3):
        some = np.array([keys[r.randrange(4000)] if r.random() < 0.8 else r.randrange(1 << 64) for _ in range(9000)], np.uint64)
        assert (pairs.level(some) == plain(bloom, some)).all()
    high = {k for k, n in zip(keys.tolist(), plain(bloom, keys)) if n >= lm.HIGH}
    assert len(high) > 500 and not any(n > 1 for k, n in zip(*map(list, np.unique(np.array(probed, np.uint64), return_counts=True))) if int(k) in high)
    assert len(pairs.level(keys[:0])) == 0


def test_executors_let_the_filters_go(spark, docs, monkeypatch):
    """Once the rows are scored, no executor keeps a copy of the broadcast filters; a repeated run doesn't add to the one before."""
    freed, unpersist = [], Broadcast.unpersist
    monkeypatch.setattr(Broadcast, "unpersist", lambda self, blocking=False: freed.append(isinstance(self.value, lm.Model)) or unpersist(self, blocking))
    rows = [(i, f"some words and {i}", "en") for i in range(30)]
    assert lm.score_all(docs(rows)).count() == 30 and freed == [True]


def test_pairs_of_a_common_word_are_spread_over_shards():
    r = random.Random(8)
    first, second = np.array([r.randrange(1 << 64)] * 20_000, np.uint64), np.array([r.randrange(1 << 64) for _ in range(20_000)], np.uint64)
    keys = np.sort(lm.pair_keys(first, second))
    assert np.bincount((keys >> np.uint64(60)).astype(int), minlength=16).max() < 2000
    assert (lm.contexts_of(keys) == first >> lm.LOW << lm.LOW).all() and len(np.unique(keys)) == len(np.unique(second >> np.uint64(34)))


def test_packed_keys_come_back():
    r = random.Random(2)
    for n in (0, 1, 7, 3000):
        keys = np.sort(np.array([r.randrange(1 << 64) for _ in range(n)], np.uint64))
        assert (lm.unpacked(pa.scalar(lm.packed(keys), pa.binary())) == keys).all()
    near = (np.uint64(1) << np.uint64(63)) + np.arange(100_000, dtype=np.uint64) * np.uint64(900)
    assert len(zlib.compress(lm.packed(near))) < len(zlib.compress(near.tobytes())) / 4


def test_batches_are_small_and_tables_go(spark, docs, monkeypatch):
    """Arrow batches of a few MB in every task, the session's own setting afterwards, and no folder left once texts are scored."""
    setting, seen, folders = "spark.sql.execution.arrow.maxBytesPerBatch", [], []
    before, count, new = spark.conf.get(setting), lm.count, lm.shared_dir
    monkeypatch.setattr(lm, "count", lambda *a: seen.append(spark.conf.get(setting)) or count(*a))
    monkeypatch.setattr(lm, "shared_dir", lambda *a: folders.append(new(*a)) or folders[-1])
    rows = [(i, f"some words and {i}", "en") for i in range(30)]
    for mb in (0, 160):
        assert lm.score_all(docs(rows), max_mb=mb).count() == 30
    assert spark.conf.get(setting) == before and len(seen) == 2 and all(int(x) <= 8 << 20 for x in seen)
    assert folders and not any(Path(f).exists() for f in folders)
