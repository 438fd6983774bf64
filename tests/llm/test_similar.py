import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
from quern.llm import similar, simhash


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def linked(a, b):
    a, b = grams(a), grams(b)
    return a == b or bool(a or b) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def planted():
    """Base texts with a line in common, and copies of each with more and more words replaced."""
    r = random.Random(5)
    line, rows, n = " ".join(f"line{k}" for k in range(40)), [], 0
    for base in range(25):
        own = [f"w{r.randrange(3000)}" for _ in range(r.choice([6, 30, 120, 300]))] + line.split()
        for copy in range(8):
            text = list(own)
            for _ in range(copy * len(own) // 250 + (copy > 0)):
                text[r.randrange(len(text))] = f"new{r.randrange(10**6)}"
            rows.append((n := n + 1, " ".join(text), "en"))
    return rows + [(n + 1, rows[0][1].upper(), "en"), (n + 2, line, "en"), (None, rows[9][1], "en")]


def test_near_duplicates_stage_finds_all_planted_copies(spark, docs, awkward):
    rows = planted() + [(i + 1000 if i is not None else None, t, k) for i, t, k in awkward]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if linked(rows[a][1], rows[b][1]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(root(k), []).append(row[0])
    want = sorted(min((i is None, i or 0) for i in ids) for ids in groups.values())
    assert 30 < len(want) < len(rows) - 60
    df = docs(rows)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in kept.select("doc_id").collect()) == want
    assert corpus_pipeline.near_duplicates(spark, docs([]), "").count() == 0


def test_prefixes_and_short_texts():
    assert [similar.prefix(n) for n in (0, 1, 4, 5, 10)] == [0, 1, 1, 2, 3]
    assert [len(similar.shingles(t)) for t in (b"", b"a", b"a b c d", b"A b c d e", b"a b c d e f")] == [0, 1, 1, 1, 2]


def test_links_of_fingerprints_count(spark, docs, monkeypatch):
    """Texts of a line again and again, with some words of their own: only the anchors' links join them."""
    line = " ".join(f"line{k}" for k in range(21))
    own = lambda n, k: " ".join(f"own{n}x{j}" for j in range(k))
    rows = [(n, f"{line} " * 10 + own(n, 20), "en") for n in range(1, 9)]  # 206 shingles in common, 24 of each text's own
    rows += [(n, f"{line} " * 60 + own(n, 1500), "en") for n in (11, 12)]  # as many of their own
    rows += [(21, own(21, 80), "en"), (22, own(21, 80) + " more", "en"), (23, own(23, 80), "en")]

    def weighed(a, b):
        a, b = (Counter(zip(*(w[k:] for k in range(5)))) for w in (a.split(), b.split()))
        return sum((a & b).values()) / sum((a | b).values())

    def least(bits):
        """The least id of each component."""
        fps, of = {i: simhash.fingerprint(t.encode(), 5) for i, t, _ in rows}, {i: i for i, _, _ in rows}
        for (i, t, _), (j, u, _) in combinations(rows, 2):
            if linked(t, u) or (fps[i] ^ fps[j]).bit_count() <= bits and weighed(t, u) >= 0.8:
                of = {k: min(of[i], of[j]) if r in (of[i], of[j]) else r for k, r in of.items()}
        return sorted(set(of.values()))

    kept = lambda: sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs(rows), "").collect())
    assert not linked(rows[0][1], rows[1][1]) and len(least(2)) < len(least(0)) < len(rows)
    assert kept() == least(2)
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, t: links(distinct, t).where("false"))
    assert kept() == least(0)


def test_shared_passages_alone_make_no_candidates(spark, docs, monkeypatch):
    """Texts with passages in common and a third of their own are never paired; the stage's tables go when it ends."""
    passages = [" ".join(f"p{k}x{j}" for j in range(40)) for k in range(6)]
    rows = [(n, f"{passages[n % 6]} {passages[(n + 1) % 6]} " + " ".join(f"own{n}x{j}" for j in range(50)), "en") for n in range(60)]
    folders, shared_dir, seen = [], similar.shared_dir, {}
    monkeypatch.setattr(similar, "shared_dir", lambda *x: folders.append(shared_dir(*x)) or folders[-1])
    components = simhash.components

    def spied(pairs):
        seen.update({name: spark.read.parquet(f"{folders[-1]}/{name}").count() for name in ("shared", "sets")})
        return components(pairs)

    monkeypatch.setattr(simhash, "components", spied)
    assert corpus_pipeline.near_duplicates(spark, docs(rows), "").count() == 60
    assert seen == {"shared": 0, "sets": 0}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folders[-1])
    assert not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def test_bounds_of_candidates_change_no_row(spark, docs, monkeypatch):
    """A filter that holds nothing, sets that are joined, and small heaps in many turns give the same rows."""
    df = docs(planted())
    kept = lambda: sorted(str(x["doc_id"]) for x in corpus_pipeline.near_duplicates(spark, df, "").collect())
    want = kept()
    monkeypatch.setattr(similar, "FILTER_MB", 0)
    monkeypatch.setattr(similar, "ASKED", 0)
    assert kept() == want
    for name, value in (("FILTER_MB", 64), ("HEAP", 2), ("ROUNDS", 2), ("PAIRS", 0)):
        monkeypatch.setattr(similar, name, value)
    assert kept() == want
