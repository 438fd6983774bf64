"""op8 and op10: against SQL on a small fixture, and their edge cases."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, urls

TEXTS = ["plain", "", None, "### user: hi </turn>\n### x: y", "\\h \\b \\\\", "ends </turn>", "</turn>\n###", " </turn>\n### ", "a: b", "#<>:\\", "\\### Assistant: </turn> ok"]


def test_every_text_survives_the_round_trip(spark):
    rows = [(n, t, role, x) for n, x in enumerate(TEXTS) for t, role in ((0, "user"), (1, "assistant"), (2, "odd: role </turn>"))] + [(99, 0, None, "x"), (99, 0, None, "x"), (None, None, "assistant", None)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")))
    found = {r["conv_id"]: r for r in out.collect()}
    assert len(found) == len(TEXTS) + 2
    for n, x in enumerate(TEXTS):
        assert [tuple(t) for t in found[n]["turns"]] == [("user", x or ""), ("assistant", x or ""), ("odd: role </turn>", x or "")]
        spans = [found[n]["formatted"][s["start"] - 1 : s["start"] - 1 + s["len"]] for s in found[n]["loss_spans"]]
        assert len(spans) == 1
    assert found[0]["level"] == 2 and [tuple(t) for t in found[99]["turns"]] == [("", "x")] * 2


def test_digests_match_the_source_and_the_sql(spark):
    rows = [(n, t, "assistant" if t % 2 else "user", x) for n in range(len(TEXTS)) for t, x in enumerate(TEXTS[n:])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r.asDict() for r in chat.digests(chat.format_conversations(df.unionByName(spark.sql(chat.ADDED)))).collect()}
    mine = [r for r in rows if r[0] == 3]
    said = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in mine)
    loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
    assert got[3]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[3]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == len("\\### Assistant: </turn> ok")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    r = con.execute(chat.ORACLE_SQL)
    names = [c[0] for c in r.description]
    assert {x["conv_id"]: x for x in (dict(zip(names, row)) for row in r.fetchall())} == got


def test_no_conversations(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("url, host, path, rule", [
    (None, "", "", None),
    ("no scheme.com/x", "", "", None),
    ("http://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/"),
    ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/"),
    ("http://a.example.com/EN/", "a.example.com", "/EN/", "com/"),
    ("http://example.com", "example.com", "", None),
    ("http://example.com?x=/en/", "example.com", "", None),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/"),
    ("ftp://b.net/es/1#top", "b.net", "/es/1", "net/es/"),
    ("http://x://y/z", "x:", "//y/z", None),
    ("http://b.org/fr/", "b.org", "/fr/", None),
])
def test_rules(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url, "r")], "page_id long, url string, rule string")
    got = urls.judge_urls(pages, spark.createDataFrame([], "page_id long, bad int")).first()
    assert (got["host"], got["path"], got["rule"]) == (host, path, rule) and got["verdict"] in ("allow", "block")


def test_reputation_needs_evidence(spark):
    bad = [(n, "http://bad.org/x") for n in range(60)]
    few = [(100 + n, "http://few.org/x") for n in range(1)]
    good = [(200 + n, f"http://good{n % 9}.org/x") for n in range(90)]
    pages = spark.createDataFrame([*bad, *few, *good, (None, "http://good1.org/x")], "page_id long, url string")
    labels = spark.createDataFrame([(n, 1) for n, _ in bad + few] + [(n, 0) for n, _ in good] + [(None, 1), (7, None)], "page_id long, bad int")
    got = {r["host"]: r["verdict"] for r in urls.judge_urls(pages, labels).collect()}
    assert got["bad.org"] == "block" and got["few.org"] == "allow" and got["good1.org"] == "allow"
    assert urls.judge_urls(pages.limit(0), labels).count() == 0
