"""What workers remember of words is bounded, and changes no score."""

from collections import Counter

import numpy as np

from quern.llm import langid, toxicity
from quern.llm.common import keep_rows


def test_scorer_remembers_few_words_and_frequent_ones_are_computed_once(monkeypatch):
    texts = [b"often seen " + b" ".join(b"w%d" % x for x in range(8 * k, 8 * k + 8)) for k in range(640)]
    net = toxicity.Network({b"often": 1, b"w7": 2}, 3)
    expected = toxicity.Scorer(net).scores(texts)
    computed = Counter()
    features = toxicity.Network.features
    monkeypatch.setattr(toxicity.Network, "features", lambda self, words: computed.update(words) or features(self, words))
    monkeypatch.setattr(toxicity, "REMEMBERED", 2400)
    scorer = toxicity.Scorer(net)
    assert np.allclose(scorer.scores(texts), expected, atol=1e-6)
    assert len(scorer.known) + len(scorer.before[0]) <= 2400 and scorer.gates.shape[1] <= 1201
    assert computed[b"often"] == computed[b"seen"] == 1


def test_scorer_holds_little_after_many_words():
    scorer = toxicity.Scorer(toxicity.Network({}, 3))
    for k in range(0, 150_000, 10_000):
        scorer.learn([[b"%d" % x for x in range(k, k + 10_000)]])
    assert scorer.gates.nbytes < 12e6


def test_language_remembers_few_words_and_frequent_ones_are_scored_once(monkeypatch):
    model = langid.fit({"a": Counter({"▁ab": 3, "▁ba": 1}), "b": Counter({"▁bb": 2})}, ["▁", "a", "b", "ab"])
    words = [["▁ab", *("▁" + format(x, "b").replace("0", "a").replace("1", "b") for x in range(8 * k, 8 * k + 8))] for k in range(1, 60)]
    expected = [langid.word_scores(ws, model.index, model.table).sum(axis=0) for ws in words]
    scored = Counter()
    word_scores = langid.word_scores
    monkeypatch.setattr(langid, "word_scores", lambda ws, *rest: scored.update(ws) or word_scores(ws, *rest))
    monkeypatch.setattr(langid, "REMEMBERED", 40)
    for ws, total in zip(words, expected):
        model.memory.learn(set(ws))
        assert np.allclose(model.memory.total(ws), total)
        assert len(model.memory.known) + len(model.memory.before[0]) <= 40
    assert scored["▁ab"] == 1


def test_keep_rows_judges_a_batch_in_parts(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "cast(id as string) as text")

    def judge():
        def mask(bodies):
            assert len(bodies) <= 1024
            return [int(b) % 3 == 0 for b in bodies]

        return mask

    assert [x["doc_id"] for x in keep_rows(docs, judge).collect()] == list(range(0, 3000, 3))
    assert keep_rows(docs.limit(0), judge).count() == 0
