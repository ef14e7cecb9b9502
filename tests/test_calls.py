import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.engine import Engine
from corpusloom.operators import enrich

D = datetime.date


@pytest.fixture(scope="module")
def engine(spark):
    make = spark.createDataFrame
    t = {
        "sources": make([("paper", 1, "p1", "Dense Search", D(2023, 1, 1), "rag", "retrieval", "abs", "# Intro\ndense search\n## Setup\nx"), ("paper", 2, "p2", "Trees", D(2020, 1, 1), "rag", "retrieval", "abs", "plain"), ("post", 1, "b1", "Blog", None, "vision", "nets", "abs", None)], "kind string, id long, slug string, title string, date date, domain string, collection string, abstract string, markdown string"),
        "sections": make([(1, "p1", "rag", "Intro", "1", "dense search engines"), (2, "p1", "rag", "Setup", "2", "search trees"), (3, "p2", "rag", "Trees", "1", "random trees grow"), (4, "b1", "vision", "Post", "1", "dense nets")], "key long, slug string, domain string, section_title string, section_level string, body string"),
        "readmes": make([(1, "gh-a-b", "rag", "a search tool")], "key long, slug string, domain string, body string"),
        "members": make([("p1", "rag", "retrieval"), ("p2", "rag", "retrieval"), ("b1", "vision", "nets")], "slug string, domain string, collection string"),
        "topics": make([("p1", "search"), ("p2", "search"), ("b1", "nets")], "slug string, topic string"),
        "terms": make([(1, "rag", "entity", "model", "ColBERT"), (2, "rag", "topic", None, "dense search")], "term_id long, domain string, term_type string, entity_type string, canonical_name string"),
        "aliases": make([(1, "col-bert", "p1")], "term_id long, alias string, slug string"),
        "repos": make([("gh-a-b", "https://github.com/a/b", "p1", "classified", "rag", "retrieval")], "slug string, url string, paper string, status string, domain string, collection string"),
        "code_files": make([("gh-a-b", "m.py", "python", 6, "a\nb\nc\n")], "repo string, path string, language string, size_bytes long, content string"),
        "references": make([("p1", 1, "x", "2001.00001", "p2"), ("p1", 2, "y", "2001.00002", None), ("p1", 3, "z", None, None)], "src string, ref_number long, raw_text string, cited string, cited_slug string"),
        "figures": make([("p1", 3, "3a", "cap", bytearray(b"i"), "image/png")], "slug string, number int, label string, caption string, image binary, mime string"),
    }
    return Engine(spark, t, as_of=D(2026, 1, 1))


def test_search_calls(engine):
    own = engine.bm25("search", scope="both")
    assert own["sections_total"] == 2 and own["readmes_total"] == 1 and own["sections"][0]["slug"] == "p1" and own["sections"][0]["hit_count"] == 2
    first, readme = own["sections"][0], own["readmes"][0]
    assert first["topics"] == ["search"] and first["entities"] == [{"name": "ColBERT", "type": "model"}] and first["figures"] == {"count": 1, "first_caption": "cap"} and first["repo"]["slug"] == "gh-a-b"
    assert {h["snippet"] for h in first["hits"]} == {"dense [search] engines", "[search] trees"} and readme["hits"][0]["snippet"] == "a [search] tool" and readme["paper"] == "p1" and readme["topics"] == ["search"]
    assert engine.bm25("grow dense")["fallback"] == "OR" and engine.bm25("grow trees")["fallback"] is None
    assert engine.bm25("NOT x")["status"] == "malformed_query" and engine.bm25("a domain:rag", domain="vision")["status"] == "malformed_query"
    assert {h["slug"] for h in engine.bm25("dense", since="2022")["sections"]} == {"p1"}
    assert engine.search("search")["taxonomy"][0]["canonical_name"] == "dense search"
    fused = engine.search(["search", "trees"], union=True)["results"]
    assert fused[0]["item"] == "section / p1 / Setup" and fused[0]["matched_queries"] == "0,1"
    assert engine.search(["a"] * 9)["status"] == "malformed_query"
    assert engine.lookup("col bert")["terms"][0]["sources"] == ["p1"]
    cover = engine.coverage("dense search")
    assert (cover["sections"], cover["sources"]) == (1, 1) and cover["similar"][0]["ratio"] == 100.0
    near = engine.coverage("Colberd")["similar"]
    assert [(n["bucket"], n["name"]) for n in near] == [("aliases", "col-bert"), ("entity", "ColBERT")] and near[0]["of"] == "ColBERT"
    assert engine.coverage("Retrieval")["collections_exact"] == [{"collection": "retrieval", "domain": "rag"}] and engine.coverage("tool")["repos"] == 1
    assert engine.coverage("(")["sections"] == 0


def test_view_calls(engine):
    assert engine.browse("topics")["topics"][0] == {"topic": "search", "n": 2} and engine.browse("x")["status"] == "unknown_view"
    assert engine.overview()["domains"][0]["collections"] == [{"name": "retrieval", "n": 2}]
    own = engine.collection(["retrieval", "none"])
    assert [m["slug"] for m in own["members"]] == ["p1", "p2"] and own["missing"] == ["none"]
    assert engine.toc(["p1", "zz"]) == {"status": "ok", "sections": {"p1": [{"level": 1, "title": "Intro"}, {"level": 2, "title": "Setup"}]}, "missing": ["zz"]}
    assert engine.read("p1", ["setup"])["content"] == "## Setup\nx" and engine.read("zz")["status"] == "not_found"
    assert engine.read("p1", ["no"])["titles"] == ["Intro", "Setup"] and engine.read("p1", [""])["status"] == "malformed_section_query"
    assert engine.figure("p1", "3a")["number"] == 3 and engine.figure("p1", 4)["status"] == "not_found"


def test_graph_and_code_calls(engine):
    own = engine.citations("p1")
    assert [len(own[k]) for k in ("resolved", "missing", "unresolvable")] == [1, 1, 1]
    assert engine.citations("p2", "inbound")["citing"][0]["slug"] == "p1" and engine.citations("gh-a-b", "inbound")["status"] == "unsupported_direction"
    assert engine.repo("gh-a-b")["paper"] == {"slug": "p1", "title": "Dense Search"} and engine.repo("no")["status"] == "not_found"
    tree = engine.repo_tree("gh-a-b")
    assert tree["paper_name"] == "p1" and not tree["truncated"] and engine.repo_tree("gh-a-b", limit=0)["truncated"]
    assert engine.repo_tree("gh-a-b")["bytes"] == 6 and engine.repo_tree("no")["status"] == "no_repo"
    assert engine.read_code("gh-a-b", "m.py", (2, 3))["content"] == "b\nc\n" and engine.read_code("gh-a-b", "m.py", (3, 2))["status"] == "malformed_lines"
    assert engine.query("SELECT count(*) AS n FROM sources")["rows"] == [{"n": 3}]
    assert len(engine.tables()["tables"]) == 11


def test_maintained_indexes_are_read_as_they_stand(spark, engine, tmp_path):
    from corpusloom.engine import INDEXED
    from corpusloom.operators.segments import Segments, term_rows

    own = {"sections": Segments(spark, str(tmp_path / "s"), "key", "slug", INDEXED["sections"], buckets=2), "terms": Segments(spark, str(tmp_path / "t"), "term_id", "term_id", INDEXED["terms"], stemmed=True, buckets=2)}
    own["sections"].rebuild(engine.t["sections"])
    own["terms"].rebuild(term_rows(engine.t["terms"], engine.t["aliases"]))
    held = Engine(spark, engine.t, engine.as_of, own)
    drop = lambda out: {k: v for k, v in out.items() if k != "query"}
    assert drop(held.bm25("search")) == drop(engine.bm25("search")) and held.lookup("searching") == engine.lookup("searching")
    own["sections"].apply("b", engine.t["sections"].filter("slug = 'p2'").withColumn("body", F.lit("now search")), engine.t["sections"].filter("slug = 'p1'"))
    assert [h["slug"] for h in held.bm25("search")["sections"]] == ["p2"]


def test_children_are_held_to_the_page(spark, tmp_path):
    spark.createDataFrame([(i, f"t{i}") for i in range(100)], "id long, topic string").write.parquet(str(tmp_path / "t"))
    plan = enrich.held_to(spark.read.parquet(str(tmp_path / "t")), "id", [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id, [3,5])]" in plan
    with pytest.raises(ValueError):
        none = spark.createDataFrame([], "id long, topic string, term_id long, term_type string, entity_type string, canonical_name string, number int, caption string, slug string, url string")
        enrich.enrich(spark.range(60), "id", none, none, none, none, none)
