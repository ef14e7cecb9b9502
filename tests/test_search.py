"""BM25 and matching against SQLite's FTS5, an independent implementation, on made-up rows."""

import datetime
import random
import sqlite3

import pytest

from corpusloom.operators import index, search
from corpusloom.plans.parser import QueryError, parse

WORDS = ["alpha", "beta", "gamma", "délta", "Über", "x1", "tree", "trees", "bge-small", "a_b", "rag", "the"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    return [(i, rng.choice(["rag", "vision"]), " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))), "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 8))) for _ in range(3))) for i in range(120)]


@pytest.fixture(scope="module")
def fts(rows):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(domain, title, body, tokenize = 'unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t (rowid, domain, title, body) VALUES (?, ?, ?, ?)", rows)
    return con


@pytest.fixture(scope="module")
def own(spark, rows):
    df = spark.createDataFrame(rows, "key long, domain string, title string, body string").cache()
    return df, index.build(df, "key", ["domain", "title", "body"])


@pytest.mark.parametrize(
    "ours, theirs",
    [("alpha", "alpha"), ("alpha beta", "alpha AND beta"), ("alpha OR gamma NOT beta", "alpha OR (gamma NOT beta)"), ('"alpha beta"', '"alpha beta"'), ("tree*", "tree*"), ("delta uber", "delta AND uber"), ("bge-small", '"bge small"'), ("a_b rag", '"a b" AND rag'), ("(alpha OR beta) tree* NOT x1", "((alpha OR beta) AND tree*) NOT x1"), ('"the rag al*"', '"the rag al"'), ("alpha alpha", "alpha AND alpha"), ("zzz", "zzz")],
)
def test_scores_equal_fts5(own, fts, ours, theirs):
    got = {r["key"]: r["score"] for r in index.bm25(own[1], parse(ours).node).collect()}
    want = dict(fts.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (theirs,)).fetchall())
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6, abs=1e-9)


def test_saved_index_gives_the_same(spark, own, tmp_path):
    own[1].save(str(tmp_path), buckets=4)
    held = index.Index.load(spark, str(tmp_path), "key")
    q = parse("alpha tree*").node
    assert {tuple(r) for r in index.bm25(held, q).collect()} == {tuple(r) for r in index.bm25(own[1], q).collect()}


def test_filters_paging_and_fallback(spark, own):
    df, ix = own
    df = df.withColumn("slug", df["key"].cast("string"))
    everything = [(r["key"], r["rank"]) for r in search.page(search.ranked(ix, df, "alpha"), "key", 100).collect()]
    assert [r for _, r in everything] == list(range(1, len(everything) + 1))
    second = [(r["key"], r["rank"]) for r in search.page(search.ranked(ix, df, "alpha"), "key", 5, offset=5).collect()]
    assert second == everything[5:10]
    rag = search.ranked(ix, df, "alpha domain:rag")
    assert {r["domain"] for r in rag.collect()} == {"rag"}
    scores = {r["key"]: r["score"] for r in search.ranked(ix, df, "alpha").collect()}
    assert all(scores[r["key"]] == r["score"] for r in rag.collect())
    found, how = search.with_fallback(lambda q: search.ranked(ix, df, q), "alpha zzz")
    assert how == "OR" and {r["key"] for r in found.collect()} == scores.keys()
    assert search.with_fallback(lambda q: search.ranked(ix, df, q), "alpha OR zzz")[1] is None
    with pytest.raises(QueryError):
        search.ranked(ix, df, "domain:rag")


def test_recency_and_since(spark, own):
    df, ix = own
    df = df.withColumn("slug", df["key"].cast("string"))
    dates = spark.createDataFrame([("0", datetime.date(2026, 1, 1)), ("1", datetime.date(2019, 1, 1))], "slug string, date date")
    today = datetime.date(2026, 1, 1)
    base = {r["slug"]: r["score"] for r in search.ranked(ix, df, "alpha OR beta OR the").collect()}
    new = {r["slug"]: r["score"] for r in search.ranked(ix, df, "alpha OR beta OR the", sources=dates, boost=0.2, as_of=today).collect()}
    for s, v in base.items():
        factor = {"0": 1.2, "1": 1 + 0.2 * 2.718281828459045 ** (-2557 / 730)}.get(s, 1)
        assert new[s] == pytest.approx(v * factor, rel=1e-5, abs=2e-9)
    late = lambda **k: {r["slug"] for r in search.ranked(ix, df, "alpha OR beta OR the", sources=dates, since="2020", **k).collect()}
    assert late() <= {"0"} and "1" not in late(keep_undated=True)
    with pytest.raises(QueryError):
        search.since_date("soon")


def test_fusion(spark):
    lists = list(enumerate(spark.createDataFrame(r, "item string, rank long") for r in ([("a", 1), ("b", 2), ("b", 5)], [("b", 1), ("c", 2)])))
    got = [(r["item"], round(r["fused"], 9), r["matched_queries"], r["rank"]) for r in search.fuse(lists).orderBy("rank").collect()]
    # an item counts for each of its places in a list
    assert got == [("b", round(1 / 62 + 1 / 65 + 1 / 61, 9), "0,1", 1), ("a", round(1 / 61, 9), "0", 2), ("c", round(1 / 62, 9), "1", 3)]
    with pytest.raises(QueryError):
        search.fuse([(q, lists[0][1]) for q in range(9)])


def test_pages_are_ranked_anew_by_source(spark):
    page = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4), ("b", 5)], "slug string, rank int")
    assert [(r["slug"], r["rank"]) for r in search.flattened(page).orderBy("rank").collect()] == [("a", 1), ("a", 2), ("b", 3), ("b", 4), ("c", 5)]
