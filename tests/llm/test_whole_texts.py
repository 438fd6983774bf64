"""Long words, odd letters, ties and repeats: nothing is cut off, and scores are those of plain loops."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import chat, langid, simhash, toxicity, urls
from quern.llm.common import TOKENIZERS, held_out, least_hashed

VOCABULARY = f"{TOKENIZERS}/piece_bpe_32k.model"
GERMAN, ENGLISH = "schönerwanderwegüberdenberg", "thewaterandthehouseofthelight"


def model(docs):
    rows = [(i, f"{'der schöne wanderweg über den berg' if i % 2 else 'the water and the house of the light'} {i}", "de" if i % 2 else "en") for i in range(60)]
    return langid.train(docs(rows), F.lit(True), VOCABULARY)


def test_language_of_words_of_thousands_of_letters(docs):
    m = model(docs)
    lang, score, _ = langid.verdicts(m, [(GERMAN * 190).encode(), (ENGLISH * 190).encode(), ("日" * 100 + GERMAN).encode(), ("日" * 100 + ENGLISH).encode(), "½ ² ③".encode(), "12 ½ z".encode()])
    assert lang[:4] == ["de", "en", "de", "en"] and min(score[:4]) > 0.5 and lang[4] == "und" and score[4] == 0 and lang[5] != "und"


def test_long_words_score_like_short_ones_one_by_one():
    """Scaled passes against plain sums in logarithms."""
    pieces = ["a", "b", "ab", "ba", "abb", "▁", "▁a"]
    p = np.array([[0.2, 0.1], [0.1, 0.2], [0.1, 0.05], [0.3, 0.2], [0.05, 0.1], [0.15, 0.3], [0.1, 0.05], [1e-6, 1e-6], [0, 0]])
    r = np.random.default_rng(1)
    for n in (15, 16, 17, 33, 100, 1200):
        w = "▁" + "".join(r.choice(list("abx"), n))
        a = np.full((len(w) + 1, 2), -np.inf)
        a[0] = 0
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - 3), j):
                k = pieces.index(w[i:j]) if w[i:j] in pieces else 7 if j == i + 1 else -1
                if k >= 0:
                    a[j] = np.logaddexp(a[j], a[i] + np.log(p[k]))
        assert np.allclose(langid.word_scores([w], langid.indexed(pieces), p)[0], a[-1], rtol=1e-9)


def test_texts_of_no_learned_language_are_rejected(docs):
    m = model(docs)
    r = np.random.default_rng(2)
    noise = [(200 + n, " ".join("".join(r.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(20)), None) for n in range(5)]
    kept = langid.keep(docs([(1, "the house and the water", "en"), (2, "der berg und der weg", "de"), *noise]), m)
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 2]


def test_samples_are_the_least_hashed_of_each_class(spark):
    rows = spark.createDataFrame([("x" if i % 10 else "y", i) for i in range(5000)] + [("x", 1)] * 3000, "lang string, doc_id long")
    got = least_hashed(rows, "lang", lambda v: 20 if v == "x" else 7)
    order = {r["doc_id"]: r["h"] for r in rows.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for v, n in (("x", 20), ("y", 7)):
        ids = sorted({i for i in order if (i % 10 > 0) == (v == "x")}, key=order.get)[:n]
        assert sorted(i for lang, i in got if lang == v) == sorted(ids)


def plain_score(net, text):
    """The greatest logit of all windows, word by word in plain loops."""
    words, h, best = toxicity.split_words(text), toxicity.HIDDEN, -np.inf
    s = lambda x: 1 / (1 + np.exp(-x))
    for start in toxicity.windows(len(words)):
        window = words[start : start + toxicity.WIDTH]
        x = [np.concatenate([net.p["word"][net.vocabulary.get(w, 0)], np.mean([net.p["char"][g] for g in toxicity.trigrams(w)], axis=0)]) for w in window]
        states = np.zeros((len(window), 2 * h))
        for d, order in ((0, range(len(window))), (1, range(len(window) - 1, -1, -1))):
            state = np.zeros(h)
            for t in order:
                g, u = x[t] @ net.p["wx"][d] + net.p["wb"][d, 0], state @ net.p["uh"][d]
                z, r = s(g[:h] + u[:h]), s(g[h : 2 * h] + u[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
                states[t, d * h : (d + 1) * h] = state
        e = np.exp([np.tanh(y @ net.p["ta"]) @ net.p["va"] for y in states])
        best = max(best, float((e / e.sum()) @ states @ net.p["uo"] + net.p["bo"][0]))
    return s(best)


def test_toxicity_scores_are_those_of_plain_loops():
    net = toxicity.Network({b"bad": 1, b"word": 2}, 3)
    r = np.random.default_rng(4)
    some = [b"bad", b"word", b"other", b"thing", b"x" * 100]
    texts = [b" ".join(r.choice(some, n)) for n in (1, 2, 47, 48, 49, 130, 400)]
    assert np.allclose(toxicity.Scorer(net).scores(texts), [plain_score(net, t) for t in texts], atol=1e-4)


def test_all_bytes_of_a_word_count():
    a, b = (toxicity.split_words(b"x" * 64 + w) for w in (b"idiot", b"flower"))
    assert a != b and b"".join(toxicity.split_words(b"q" * 5000 + b"idiot")) == b"q" * 5000 + b"idiot"
    net = toxicity.Network({}, 3)
    s = toxicity.Scorer(net).scores([b"x" * 64 + b"idiot", b"x" * 64 + b"flower"])
    assert s[0] != s[1]


def test_urls_repeated_long_and_tied(spark):
    rules = (("com", "/a", "block"), ("x.com", "/", "allow"), ("com", "/b", "allow"), ("com", "/b", "block"))
    long = "http://h.com/" + "p" * 200_000
    pages = spark.createDataFrame([(1, "http://x.com/a"), (1, "http://x.com/a"), (2, long), (3, "http://y.com/b")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0), (1, 1)], "page_id long, bad int")
    got = urls.judge_urls(pages, labels, rules).collect()
    assert sorted(r["page_id"] for r in got) == [1, 1, 2, 3]
    by = {r["page_id"]: r for r in got}
    assert by[1]["rule"] == "x.com/" and len(by[2]["path"]) == 200_001 and by[2]["rule"] is None and (by[3]["rule"], by[3]["verdict"]) == ("com/b", "allow")


def test_very_long_conversation(spark):
    text = "### user: </turn>\\ " * 20_000
    out = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")).first()
    assert [tuple(t) for t in out["turns"]] == [("user", "q"), ("assistant", text)]


def test_a_large_star_is_one_component(spark):
    """A text linked to many, ids in no order: the smallest id, once, for all."""
    base = 0x0F0F_1234_5678_9ABC
    ids = np.random.default_rng(5).permutation(2000)
    fps = [base ^ (1 << k % 64) ^ (1 << k // 64 % 64) if k else base for k in range(2000)]
    prints = spark.createDataFrame([(int(i), int(np.uint64(f).view(np.int64))) for i, f in zip(ids, fps)], "doc_id long, fp long")
    found = simhash.classes(prints).select("component_id").distinct().collect()
    assert [r["component_id"] for r in found] == [0]


def test_pipeline_stages_name_their_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "encoding"]
    assert held_out("doc_id", 3, 1) is not None
