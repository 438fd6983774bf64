"""op1, op2, op4, op5, op6, op7 and op9: against brute force, exact round trips or held-out accuracy, and their edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, lm, sentencepiece, simhash, tokens, toxicity
from quern.llm.common import TOKENIZERS, held_out

VOCABULARY = f"{TOKENIZERS}/piece_bpe_32k.model"


def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(min(len(word), at + 16), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def test_automaton_counts_what_greedy_matching_builds():
    r = random.Random(1)
    pieces = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(60)} | {"a", "b"})
    machine = tokens.Automaton(pieces)
    for _ in range(3000):
        w = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randint(0, 14)))
        assert machine.count(w) == greedy(w, set(pieces)), w


def test_token_counts(docs, awkward):
    out = tokens.count_tokens(docs(awkward), VOCABULARY).collect()
    assert len(out) == len(awkward)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 0 and by[None]["n_words"] == 6
    assert by[5]["n_words"] == 30_000 and by[5]["n_unknown"] == 0 and by[7]["n_unknown"] >= 1
    assert tokens.count_tokens(docs([]), VOCABULARY).count() == 0


def test_language_model_base_and_gain(docs, awkward):
    r = random.Random(2)
    kinds = [[f"w{a}{n}" for n in range(60)] for a in "xy"]
    rows = [(100 + i, " ".join(r.choice(kinds[i % 2][:30]) for _ in range(40)), "en") for i in range(120)] + awkward
    got = lm.score_all(docs(rows)).collect()
    assert len(got) == len(rows)
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    toks = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for i, t, _ in rows if train(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, not train(i), len(toks(t)), sum(w in c for w in toks(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 4)) for i, t, _ in rows)
    assert Counter((g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], round(g["base_score"], 4)) for g in got) == want
    assert all(g["train_tokens"] == n and g["score"] <= 0 for g in got)
    assert sum(g["score"] for g in got if g["held_out"]) > sum(g["base_score"] for g in got if g["held_out"])
    assert lm.score_all(docs([])).count() == 0
    alone = lm.score_all(docs([(7, "x", "en"), (3, "x", "en")]).where(~(~held_out("doc_id", 7, 2)))).collect()
    assert all(a["train_tokens"] == 0 for a in alone)


def test_log_bloom_never_loses_a_count():
    r = np.random.default_rng(3)
    keys = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    counts = np.floor(r.pareto(1.0, 3000) * 2 + 1)
    f = lm.LogBloom(1, 4, {s: lm.LogBloom.build(1, keys[keys >> np.uint64(60) == s], counts[keys >> np.uint64(60) == s]) for s in range(16)})
    assert (f.level(keys) >= lm.levels(1, counts)).all() and (f.level(keys) == lm.levels(1, counts)).mean() > 0.98
    assert (f.level(r.integers(0, 1 << 63, 3000, dtype=np.uint64)) > 0).mean() < 0.02
    for kind in (1, 2):
        c = np.arange(1, 5000)
        v = lm.value_of(kind, lm.levels(kind, c))
        assert (v[:3] == c[:3]).all() and (np.maximum(v / c, c / v) < lm.BASES[kind]).all()


def brute_tiles(item, doc, least):
    """Greedy string tiling by comparing every pair of places."""
    gone_i, gone_d, total = set(), set(), 0
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in gone_i and d + n not in gone_d:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, d, n)
        if best is None:
            return total
        i, d, n = best
        gone_i |= set(range(i, i + n))
        gone_d |= set(range(d, d + n))
        total += n


def test_tiling_covers_what_brute_force_covers():
    r = random.Random(4)
    for _ in range(150):
        item, doc = ([r.randint(1, 4) for _ in range(n)] for n in (r.randint(3, 25), r.randint(3, 40)))
        tiles = decontaminate.tile(np.array(item), np.array(doc), 3)
        assert sum(t[2] for t in tiles) == brute_tiles(item, doc, 3)
        assert all(item[i : i + n] == doc[d : d + n] for i, d, n in tiles)
        places = [p for i, _, n in tiles for p in range(i, i + n)]
        assert len(places) == len(set(places))


def test_leaks(spark, docs, awkward, monkeypatch):
    a, b = " ".join(f"alpha{n}" for n in range(30)), "short item, three"
    bench = spark.createDataFrame([(1, a), (2, b), (3, None), (4, ""), (None, "null id item of seven words here")], "item_id long, text string")
    w = a.split()
    rows = [(10, f"before {a.upper()} after", "en"), (11, " ".join(w[15:] + ["and"] + w[:15]), "en"), (12, " ".join(w[:14]), "en"), (13, " ".join(w[::2]), "en"), (14, "a Short item: three.", "en"), (15, "null id item of seven words here", "en"), *awkward]
    for bits in (22, 6):  # a filter that lets nearly all through changes nothing
        monkeypatch.setattr(decontaminate, "LEAST_BITS", bits)
        monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
        got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs(rows), bench).collect()}
        assert set(got) == {(10, 1), (11, 1), (14, 2), (15, None)} and got[11, 1]["tiles"] == 2
    kept = decontaminate.keep(docs(rows), bench)
    assert kept.columns == docs(rows).columns and kept.count() == len(rows) - 4
    assert decontaminate.leaks(docs(rows), bench.limit(0)).count() == 0 and decontaminate.leaks(docs([]), bench).count() == 0


def all_segmentations(word, p):
    return 1.0 if not word else sum(p[word[:k]] * all_segmentations(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "abb", "▁", "▁a"]
    p = np.array([[0.2, 0.1], [0.1, 0.2], [0.1, 0.05], [0.3, 0.2], [0.05, 0.1], [0.15, 0.3], [0.1, 0.05], [1e-6, 1e-6], [0, 0]])
    words = ["▁abba", "▁bbbb", "▁aaab", "▁babb"]
    got = langid.word_scores(words, langid.indexed(pieces), p)
    for w, row in zip(words, got):
        for k in range(2):
            assert math.isclose(math.exp(row[k]), all_segmentations(w, {x: p[n, k] for n, x in enumerate(pieces)}), rel_tol=1e-9)


WORDS = {"en": "the of and with thing house over water light".split(), "de": "der und nicht schön straße über haus wasser".split(), "fr": "être pour avec maison où déjà très lumière".split()}


def test_languages(docs, awkward):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(WORDS[k]) for _ in range(20)), k) for i, k in enumerate(list(WORDS) * 30, 100)]
    df = docs([*rows, *awkward])
    got = {x["doc_id"]: x for x in langid.identify(df).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows if got[i]["held_out"])
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[8]["lang_pred"] == "und" and got[8]["score"] == 0
    assert all(0 <= x["score"] <= 1 for x in got.values())
    kept = langid.keep(df, langid.train(df, ~held_out("doc_id", 3, 1), VOCABULARY))
    assert kept.columns == df.columns and not {1, 2, 8} & {x["doc_id"] for x in kept.select("doc_id").collect()}
    assert {x["lang_pred"] for x in langid.identify(docs([(1, "words", None)])).collect()} == {"und"}
    assert langid.identify(docs([])).count() == 0


def slow_fingerprint(text, width=3):
    w = text.lower().split() if isinstance(text, bytes) else text.encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_golay_homes():
    r = random.Random(6)
    for n in (0, 1, 2, 3, 4, 50):
        t = " ".join(r.choice(["One", "two", "é", "x"]) for _ in range(n)).encode()
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    errors = simhash.errors(2)
    assert all(len(e[0]) == 1 and bin(int(e[0][0])).count("1") <= 3 for e in errors) and len({int(e[0][0]) for e in errors}) == 2048


def test_links_are_those_of_brute_force(spark):
    r = np.random.default_rng(7)
    base = r.integers(-(1 << 62), 1 << 62, 60, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(k) for k in r.choice(63, r.integers(0, 5), replace=False)) for b in base for _ in range(6)]
    fps = sorted({*map(int, base), *near, 0, -1})
    want = {(a, b) for n, a in enumerate(fps) for b in fps[n + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    got = [tuple(x) for x in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    roots = {x["node"]: x["root"] for x in simhash.components(spark.createDataFrame(sorted(want), "a long, b long")).collect()}
    assert all(roots.get(f, f) == find(f) for f in fps)


def test_near_duplicates(docs, awkward):
    rows = [*awkward, (20, "A b C", "en"), (21, "a B c", "en"), (22, "", "en"), (None, None, "en")]
    got = simhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    of = {x["doc_id"]: x["component_id"] for x in got if x["doc_id"] is not None}
    assert of[1] == of[2] == of[22] == 1 and of[20] == of[21] == 20 and of[3] == 3 and {x["component_id"] for x in got if x["doc_id"] is None} == {1, None}
    kept = simhash.keep_one(docs(rows))
    ids = [x["doc_id"] for x in kept.select("doc_id").collect()]
    assert kept.columns == docs(rows).columns and ids.count(3) == 1 and 21 not in ids and 2 not in ids and 1 in ids
    assert simhash.near_duplicates(docs([])).count() == 0


def test_gradients_are_those_of_differences():
    net = toxicity.Network({b"bad": 1, b"word": 2}, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [b"bad", b"word", b"other", b"thing"]
    feats = net.features(words)
    ids = np.random.default_rng(1).integers(0, 5, (3, toxicity.WIDTH))
    y, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        z = net.forward(net.gates(net.inputs(feats)), ids)
        return float((np.logaddexp(0, z) - y * z).sum() / 3)

    _, grad = net.gradients(net.inputs(feats), feats, ids, y, weight)
    for name, at in (("uh", (0, 2, 5)), ("uh", (1, 1, 20)), ("wx", (0, 3, 9)), ("wb", (1, 0, 4)), ("ta", (3, 2)), ("va", (1,)), ("uo", (4,)), ("bo", (0,)), ("word", (1, 3))):
        net.p[name][at] += 1e-2
        up = loss()
        net.p[name][at] -= 2e-2
        down = loss()
        net.p[name][at] += 1e-2
        assert grad[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-4), name


def test_windows_overlap_and_cover():
    for n in (0, 1, 47, 48, 49, 80, 81, 200, 1000):
        w = toxicity.windows(n)
        assert w[0] == 0 and w[-1] + toxicity.WIDTH >= n and all(b - a < toxicity.WIDTH for a, b in zip(w, w[1:]))


def test_toxicity(spark, docs, awkward):
    r = random.Random(8)
    plain = [f"word{n}" for n in range(200)]

    def text(toxic):
        w = [r.choice(plain) for _ in range(r.randint(20, 150))]
        for _ in range(max(1, len(w) // 12) if toxic else 0):
            w[r.randrange(len(w))] = r.choice(["idiot", "Scum", "pathetic!", "loser"])
        return " ".join(w)

    rows = [(i, text(i % 3 == 0), "en") for i in range(100, 400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _, _ in rows] + [(None, 1), (5, None), (100, 0)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.judge(docs([*rows, *awkward]), labels).collect()}
    out = [(got[i]["predicted"], int(i % 3 == 0)) for i, _, _ in rows if got[i]["held_out"]]
    assert np.mean([a == b for a, b in out]) > 0.9 and got[1]["score"] == got[2]["score"] == 0 and all(0 <= x["score"] <= 1 for x in got.values())
    assert {x["score"] for x in toxicity.judge(docs(rows), labels.limit(0)).collect()} == {0.0}
    assert toxicity.judge(docs([]), labels).count() == 0


def best_ids(chunk, v):
    """The best of all segmentations, by enumeration; of equal sums the longest last piece, place by place."""
    pieces = {p: (i, x) for p, i, x in v.pieces}

    def all_of(end):
        if not end:
            yield 0.0, (), ()
        for start in range(max(0, end - v.longest), end):
            p = chunk[start:end]
            ids, score = ((pieces[p][0],), pieces[p][1]) if p in pieces else (tuple(v.byte_ids[b] for b in p.encode()), sentencepiece.FALLBACK) if end - start == 1 else (None, 0)
            if ids is not None:
                for total, lasts, before in all_of(start):
                    yield total + score, (end - start, *lasts), before + ids

    return max(all_of(len(chunk)))[2]


def test_lattice_finds_the_best_of_all_segmentations(spark):
    v = sentencepiece.Vocabulary(VOCABULARY)
    r = random.Random(11)
    chunks = sorted({"".join(r.choice("theaionsé日 ") for _ in range(r.randint(1, 11))) for _ in range(150)} | {"aaaaaaaaaaaa", " the", "ñ日", "日", "𐍈a"})
    df = spark.createDataFrame([(n, c, 1) for n, c in enumerate(chunks)], "cid long, chunk string, n long")
    got = {x["chunk"]: np.frombuffer(v.ids(x["chunk"], x["ways"]), np.int32).tolist() for x in sentencepiece.segmentations(df, v).collect()}
    assert got == {c: list(best_ids(c, v)) for c in chunks}


def test_cuts_are_crossed_by_no_piece():
    v = sentencepiece.Vocabulary(VOCABULARY)
    text = "Don't stop: naïve café\r\n\x00 e\u0301  12345 xq日本語qz"
    parts = v.chunks(text)
    assert "".join(parts) == " " + text and len(parts) > 20
    assert not any(a[-1] + b[0] in p for a, b in zip(parts, parts[1:]) for p, _, _ in v.pieces)


def test_encoding_round_trips(docs, awkward):
    v = sentencepiece.Vocabulary(VOCABULARY)
    rows = [*awkward, (30, "Don't stop: naïve café\r\n\x00 e\u0301", "en"), (31, "a b" * 5, "en")]
    df, seen = docs(rows), []
    for head in (0, 20, 400_000):
        got = sentencepiece.encode(df, VOCABULARY, head).collect()
        assert len(got) == len(rows) and all(x["round_trip"] and x["n_pieces"] == len(x["ids"]) for x in got)
        seen.append(sorted((x["doc_id"] or -1, x["ids"]) for x in got))
    assert seen[0] == seen[1] == seen[2]
    text = {i: t or "" for i, t, _ in rows}
    for x in got:
        assert v.decode(x["ids"]).decode() == text[x["doc_id"]]
        if x["doc_id"] == 31:  # as chunk by chunk
            assert x["ids"] == [i for c in v.chunks(text[31]) for i in best_ids(c, v)]
    assert sentencepiece.encode(docs([]), VOCABULARY).count() == 0
