"""A maintained index scores like one built anew, whatever batches, merges and crashes led to it."""

import random

import pytest

from corpusloom.operators import index, search, segments
from corpusloom.plans.parser import parse
from corpusloom.sources import shared

SCHEMA = "owner string, key long, title string, body string"
WORDS = ["red", "green", "blue", "naïve", "data", "x1"]


def section(rng, owner, i):
    return (owner, owner_key(owner) * 100 + i, rng.choice(WORDS), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 8))))


def owner_key(owner):
    return int(owner[1:]) if owner else 999


def made(spark, tmp_path, **args):
    return segments.Segments(spark, str(tmp_path / "i"), "key", "owner", ["title", "body"], buckets=4, **args)


def scores(spark, own, query="red AND (green OR data*) NOT x1"):
    return {r[0]: round(r["score"], 9) for r in index.bm25(own, parse(query).node).collect()}


def same(spark, own, held):
    rows = [r for v in held.values() for r in v]
    df = spark.createDataFrame(rows, SCHEMA)
    manifest = own.manifest()
    assert manifest.rows == len(rows)
    assert sorted(map(tuple, own.rows().select("owner", "key", "title", "body").collect()), key=repr) == sorted(rows, key=repr)
    for query in ("red AND (green OR data*) NOT x1", '"red green" OR naive', "blue"):
        assert scores(spark, own.index(), query) == scores(spark, index.build(df, "key", ["title", "body"]), query), query


def test_batches_equal_a_full_rebuild(spark, tmp_path):
    rng = random.Random(3)
    held = {f"d{i}": [section(rng, f"d{i}", j) for j in range(rng.randint(1, 4))] for i in range(20)}
    held[None] = [section(rng, None, 0)]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    own = made(spark, tmp_path)
    with pytest.raises(ValueError):
        own.index()
    own.rebuild(frame([r for v in held.values() for r in v]))
    same(spark, own, held)
    for n in range(4):
        changed = {f"d{i}": [section(rng, f"d{i}", j) for j in range(rng.randint(1, 3))] for i in rng.sample(range(25), 5)}
        gone = [f"d{i}" for i in rng.sample(range(25), 3)]
        assert own.apply(f"b{n}", frame([r for v in changed.values() for r in v]), spark.createDataFrame([(g,) for g in [*gone, "unknown", None]], "owner string"))
        assert not own.apply(f"b{n}", frame([]))
        held = {k: v for k, v in held.items() if k not in gone} | changed
        same(spark, own, held)
        if n == 2:
            own.merge(1)
            assert len(own.manifest().segments) == 2
            same(spark, own, held)
    own.merge()
    dead = own.vacuum()
    assert dead and len(own.manifest().segments) == 1 and own.vacuum() == []
    same(spark, own, held)
    assert own.apply("all", frame([]), spark.createDataFrame([(k,) for k in held], "owner string"))
    assert own.manifest().rows == 1 and own.rows().count() == 1, "a null owner stays"


def test_a_crash_before_the_manifest_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    own = made(spark, tmp_path)
    held = {"d1": [("d1", 1, "red", "green")], "d2": [("d2", 2, "red", "data")]}
    own.rebuild(frame([r for v in held.values() for r in v]))
    real = own._commit
    monkeypatch.setattr(own, "_commit", lambda new: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        own.apply("b", frame([("d1", 1, "blue", "blue")]))
    same(spark, own, held)
    monkeypatch.setattr(own, "_commit", real)
    assert own.apply("b", frame([("d1", 1, "blue", "blue")]))
    same(spark, own, held | {"d1": [("d1", 1, "blue", "blue")]})
    assert len(own.vacuum()) >= 4


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path):
    path = f"{tmp_path}/m/1.json"
    shared.commit_text(spark, path, "one")
    with pytest.raises(Exception, match="exists|Exists"):
        shared.commit_text(spark, path, "two")
    assert shared.read_text(spark, path) == "one" and shared.names(spark, f"{tmp_path}/m") == ["1.json"]


def test_the_plan_reads_the_buckets_of_the_query(spark, tmp_path):
    own = made(spark, tmp_path)
    own.rebuild(spark.createDataFrame([("d1", 1, "red", " ".join(WORDS))], SCHEMA))
    own.apply("b", spark.createDataFrame([("d2", 2, "red", "blue")], SCHEMA))
    plan = index.bm25(own.index(), parse("red blue").node)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [Or(EqualTo(term,red),EqualTo(term,blue))" in plan


def test_terms_are_rebuilt_by_what_a_source_touched(spark, tmp_path):
    terms = spark.createDataFrame([(1, "d", "entity", "m", "dense retrieval"), (2, "d", "topic", None, "running models"), (3, "d", "entity", "m", "sparse")], "term_id long, domain string, term_type string, entity_type string, canonical_name string")
    none = spark.createDataFrame([], "term_id long, alias string, slug string")
    own = segments.Segments(spark, str(tmp_path / "t"), "term_id", "term_id", segments.TERM_COLUMNS, stemmed=True, buckets=4)
    own.rebuild(segments.term_rows(terms, none))
    aliases = spark.createDataFrame([(1, "DPR", "p1"), (1, "DPR", "p2"), (3, "lexical", "p2")], "term_id long, alias string, slug string")
    touched = segments.touched_terms(aliases, spark.createDataFrame([(2,), (None,), (9,)], "term_id long"), "p1")
    assert sorted(r["term_id"] for r in touched.collect()) == [1, 2, 9]
    left = terms.filter("term_id <> 2")
    assert segments.rebuild_terms(own, "p1", left, aliases, touched)
    assert set(scores(spark, own.index(), "dpr")) == {1} and not scores(spark, own.index(), "run") and not scores(spark, own.index(), "lexical")
    full = index.build(segments.term_rows(left, aliases.filter("term_id = 1")), "term_id", segments.TERM_COLUMNS, stemmed=True)
    assert scores(spark, own.index(), "retriev OR sparse") == scores(spark, full, "retriev OR sparse")


def test_empty_sections_are_left_out(spark, tmp_path):
    own = made(spark, tmp_path)
    own.rebuild(spark.createDataFrame([("d1", 1, "red", "x")], SCHEMA))
    segments.index_source(own, "b", spark.createDataFrame([("d1", 1, "red", " \n "), ("d1", 2, "red", "blue"), ("d1", 3, "t", None)], SCHEMA))
    assert [r["key"] for r in own.rows().collect()] == [2]
    assert search.page(index.bm25(own.index(), parse("red").node), "key", 5).count() == 1


def test_a_saved_index_that_is_gone_is_built_again(spark, sf):
    from corpusloom.sources.corpus import saved_index

    first = saved_index(spark, sf, "readmes")
    assert saved_index(spark, sf, "readmes") is first and first.intact()
    fs, p = shared.file_system(spark, f"{first.path}/postings")
    fs.delete(p, True)
    assert not first.intact()
    again = saved_index(spark, sf, "readmes")
    assert again is not first and again.rows().count() == spark.read.parquet(f"{sf}/benchmark.parquet").count()
