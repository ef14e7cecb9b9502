"""One commit over all tables: readers see it whole or not at all; cascades against rows counted by hand."""

import pytest

from corpusloom.operators import cascade
from corpusloom.sources.store import Store


@pytest.fixture
def own(spark, tmp_path):
    make = spark.createDataFrame
    held = Store(spark, str(tmp_path / "s"), buckets=4)
    held.create({
        "papers": (make([(1, "p1"), (2, "p2"), (3, "p3")], "id long, slug string"), ["id"]),
        "posts": (make([(1, "b1")], "id long, slug string"), ["id"]),
        "repos": (make([(10, 1), (11, None), (12, 3)], "id long, paper_id long"), ["id"]),
        "references": (make([(1, 1, 2), (2, 1, 1), (2, 2, 3), (3, 1, None)], "paper_id long, ref_number int, cited_paper_id long"), ["paper_id"]),
        "post_references": (make([(1, 1)], "post_id long, cited_paper_id long"), ["post_id"]),
        "sections": (make([("p1", "x"), ("p1", "y"), ("p2", "z"), ("b1", "w"), (None, "n")], "slug string, body string"), ["slug"]),
        "members": (make([("paper", 1, "c"), ("post", 1, "c"), ("repo", 10, "c"), ("repo", 11, "c")], "target_kind string, target_id long, collection string"), ["target_id"]),
        "topics": (make([("paper", 1, "t1", "d"), ("repo", 10, "t2", "d"), ("post", 1, "t3", "d"), ("paper", 2, "t1", "e")], "target_kind string, target_id long, topic string, domain string"), ["target_id"]),
        "terms": (make([(1, "topic", "t1", "d"), (2, "topic", "t2", "d"), (3, "topic", "t3", "d"), (4, "entity", "x", "d"), (5, "topic", "t1", "e"), (6, "topic", "never", "d")], "id long, term_type string, canonical_name string, domain string"), ["id"]),
        "aliases": (make([(3, "a", "p1"), (2, "b", "p2"), (4, "c", "p2"), (4, "d", None)], "term_id long, alias string, source string"), ["term_id"]),
        "vectors": (make([(1, 0.5), (4, 0.5)], "term_id long, v double"), ["term_id"]),
        "code_files": (make([(10, "f"), (11, "g"), (12, "h")], "repo_id long, path string"), ["repo_id"]),
    })
    return held


def rows(own, name):
    return sorted(map(tuple, own.read(name).collect()), key=repr)


def everything(own):
    return {n: rows(own, n) for n in own.snapshot()["tables"]}


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_a_paper_goes_with_all_that_hangs_on_it(spark, own):
    got = cascade.delete(own, "papers", ids(spark, 1, 99, None))
    n = lambda name: (got[name]["deleted"], got[name]["emptied"])
    assert {k: n(k) for k in got} == {
        "papers": (1, 0), "repos": (1, 0), "references": (1, 1), "post_references": (0, 1), "sections": (2, 0), "members": (2, 0), "topics": (2, 0),
        "terms": (3, 0), "aliases": (2, 0), "vectors": (1, 0), "code_files": (1, 0),
    }
    assert rows(own, "references") == [(2, 1, None), (2, 2, 3), (3, 1, None)] and rows(own, "post_references") == [(1, None)]
    assert rows(own, "terms") == [(3, "topic", "t3", "d"), (4, "entity", "x", "d"), (5, "topic", "t1", "e")]
    assert rows(own, "aliases") == [(4, "c", "p2"), (4, "d", None)] and rows(own, "vectors") == [(4, 0.5)]
    assert rows(own, "members") == [("post", 1, "c"), ("repo", 11, "c")] and rows(own, "posts") == [(1, "b1")]
    assert own.vacuum() > 0 and rows(own, "terms") == [(3, "topic", "t3", "d"), (4, "entity", "x", "d"), (5, "topic", "t1", "e")]


def test_posts_and_repos(spark, own):
    got = cascade.delete(own, "posts", ids(spark, 1))
    assert {k: v["deleted"] for k, v in got.items()} == {"posts": 1, "sections": 1, "post_references": 1, "members": 1, "topics": 1, "terms": 2, "aliases": 1, "vectors": 0}
    got = cascade.delete(own, "repos", ids(spark, 10), topics_too=False)
    assert {k: v["deleted"] for k, v in got.items()} == {"repos": 1, "members": 1, "topics": 1, "code_files": 1}
    assert (2, "topic", "t2", "d") in rows(own, "terms")


def test_counting_changes_nothing(spark, own):
    before, version = everything(own), own.snapshot()["version"]
    assert cascade.plan(own, "papers", ids(spark, 2))[1]["references"]["deleted"] == 2
    assert cascade.delete(own, "papers", ids(spark), topics_too=False) and everything(own) == before and own.snapshot()["version"] == version


def test_only_touched_buckets_are_written(spark, own):
    parts = own.snapshot()["tables"]
    cascade.delete(own, "repos", ids(spark, 12))
    after = own.snapshot()["tables"]
    changed = {n for n in parts if parts[n]["parts"] != after[n]["parts"]}
    assert changed == {"repos", "code_files", "terms"} and sum(parts["code_files"]["parts"].get(b) != v for b, v in after["code_files"]["parts"].items()) <= 1


@pytest.mark.parametrize("fail_at", [1, 3, 6])
def test_a_job_killed_between_two_writes_changes_nothing(spark, own, monkeypatch, fail_at):
    before, real, n = everything(own), own._write, 0

    def write(name, df):
        nonlocal n
        n += 1
        if n == fail_at:
            raise OSError("killed")
        return real(name, df)

    monkeypatch.setattr(own, "_write", write)
    with pytest.raises(OSError):
        cascade.delete(own, "papers", ids(spark, 1))
    assert everything(own) == before
    monkeypatch.setattr(own, "_write", real)
    cascade.delete(own, "papers", ids(spark, 1))
    assert rows(own, "papers") == [(2, "p2"), (3, "p3")] and own.vacuum() > 0


def test_wipe_and_seed(spark, own):
    seed = spark.createDataFrame([(7, "entity", "seeded", "d")], "id long, term_type string, canonical_name string, domain string")
    counts = cascade.wipe(own, {"terms": seed})
    assert counts["papers"] == 3 and counts["terms"] == 6
    assert {n: r for n, r in everything(own).items() if r} == {"terms": [(7, "entity", "seeded", "d")]}
