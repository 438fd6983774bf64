import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import topk


def code(v):
    return int(np.packbits(np.pad(np.nan_to_num([x if x is not None else 0 for x in v]) > 0, (0, 64 - len(v))), bitorder="little").view(np.uint64)[0])


@pytest.mark.parametrize("most_segments, block", [(8, 1 << 12), (8, 3), (40, 5)])
def test_search_is_exact(spark, most_segments, block):
    r = np.random.default_rng(1)
    base = r.standard_normal((20, 64))
    rows = [(n, [float(x) for x in base[n % 20] + r.standard_normal(64) * (0.3 if n % 3 else 2)]) for n in range(200)]
    rows += [(1000 + n, rows[0][1]) for n in range(60)] + [(2000, None), (2020, []), (None, rows[1][1]), (2040, [None, 1.0]), (0, rows[0][1]), (2060, [float("nan"), -1.0] * 20)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "id long, vector array<double>, code int")
    got = {}
    for x in topk.search(df, 7, 20, block, most_segments).collect():
        got.setdefault(x["id"], []).append((x["rank"], x["distance"], x["neighbor_id"]))
    known = {i: code(v) for i, v in rows if i is not None and v}
    for q in [i for i in known if i % 20 == 0]:
        want = sorted((bin(known[q] ^ c).count("1"), i) for i, c in known.items() if i != q)[:7]
        assert [(d, i) for _, d, i in sorted(got[q])] == want
    assert set(got) == {i for i in known if i % 20 == 0}
    assert topk.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [60, 1 << 21])
def test_candidates_are_probed_in_arrays(spark, monkeypatch, most):
    """Blocks of entries give the first of all entries, ties by id, and no join makes a row for each probe or candidate."""
    r = np.random.default_rng(4)
    base = r.integers(0, 2, (6, 64))
    rows = [(n, [float(x) - 0.5 for x in base[n % 6] ^ (r.random(64) < (0.02 if n % 4 else 0.4))]) for n in range(900)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    out = topk.search(df, 5, 20, 7, 8, most)
    known = {i: code(v) for i, v in rows}
    got = {}
    for x in out.collect():
        got.setdefault(x["id"], []).append((x["rank"], x["distance"], x["neighbor_id"]))
    for q in range(0, 900, 20):
        want = sorted((bin(known[q] ^ c).count("1"), i) for i, c in known.items() if i != q)[:5]
        assert [(d, i) for _, d, i in sorted(got[q])] == want
    made = []
    monkeypatch.setattr(topk, "checkpointed", lambda df, f=topk.checkpointed: made.append(f(df)) or made[-1])
    topk.search(df, 5, 20, 7, 8, most)
    assert max(x.count() for x in made) <= len(rows)


def test_pipeline(spark, tmp_path):
    words = {"en": "the of and with thing house over water light".split(), "de": "der und nicht haus wasser schön über straße".split()}
    r = np.random.default_rng(2)
    text = lambda k, n=60: " ".join(r.choice(words[k], n)) + " " + " ".join(f"u{r.integers(1e6)}" for _ in range(30))
    item = " ".join(f"item{n}" for n in range(20))
    rows = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(150)]
    toxic = {i for i in range(0, 150, 5)}
    rows = [(i, t + " idiot scum idiot scum loser" * 3 if i in toxic else t, k) for i, t, k in rows]
    rows += [(200, rows[1][1], "en"), (201, f"{text('en', 20)} {item}", "en"), (202, "1234 5678", None), (203, None, None), (1, rows[1][1], "en")]
    folder = tmp_path / "sf"
    spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(folder))
    ids = sorted(x["doc_id"] for x in out.collect())
    assert len(ids) == len(set(ids)) and not {200, 201, 202, 203} & set(ids) and 1 in ids
    assert len(set(ids) & toxic) <= 3 and len(set(ids)) >= 110
    assert out.where(~F.col("round_trip")).count() == 0
    docs = spark.read.parquet(str(folder / "documents.parquet")).selectExpr("*", "1 AS key", "'x' AS tokens", "2L AS row", "3L AS _seeds", "4 AS fp")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(folder)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(folder)).count() == 0
