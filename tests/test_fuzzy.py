"""Joins of names lose no pair against all pairs, and compare few."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusloom.operators import fuzzy


def frame(spark, names):
    return spark.createDataFrame([("s", n) for n in names], "scope string, name string")


def edited(rng, name):
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(name) + 1)
        name = name[:at] + rng.choice(["", "x", "é", name[at : at + 1] * 2]) + name[at + rng.randint(0, 1) :]
    return name


@pytest.mark.parametrize("least", [80, 85, 92.5, 100])
def test_pairs_equal_all_pairs(spark, least):
    rng = random.Random(int(least))
    words = ["retrieval", "dense", "sparse", "graph", "neural", "net", "a", "ab", "abc", "aaaa", "abab"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["", "a", "b", "aa", "ab", "ba", "abc", "abcd", "aabb"]
    other = [edited(rng, b) for b in base for _ in range(2)]
    got = {(r["x"], r["y"]): r["ratio"] for r in fuzzy.similar_pairs(frame(spark, [*base, None]), frame(spark, [*other, None]), least, ["scope"]).collect()}
    want = {(x, y): fuzzy.ratio(x, y) for x in set(base) for y in set(other) if fuzzy.ratio(x, y) >= least and (x or y)}
    assert {k: round(v, 9) for k, v in got.items() if k != ("", "")} == {k: round(v, 9) for k, v in want.items()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc", max_size=12), min_size=1, max_size=25), st.sampled_from([80, 85, 90]))
def test_pairs_of_any_names(spark, names, least):
    got = {(r["x"], r["y"]) for r in fuzzy.similar_pairs(frame(spark, names), frame(spark, names), least, ["scope"]).collect()}
    assert got >= {(x, y) for x in names for y in names if (x or y) and fuzzy.ratio(x, y) >= least}


def test_few_pairs_are_compared(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 14))) for _ in range(600)]
    names += [edited(rng, n) for n in names[:200]]
    df = frame(spark, names)
    met = fuzzy.candidates(df, df, 85, ["scope"]).count()
    assert met < 0.05 * len(names) ** 2, met
    found = fuzzy.similar_pairs(df, df, 85, ["scope"]).count()
    assert found == sum(fuzzy.ratio(x, y) >= 85 for x in set(names) for y in set(names))
    with pytest.raises(ValueError):
        fuzzy.candidates(df, df, 70, ["scope"])


def test_topics(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "BLOCK", 3)
    rng = random.Random(2)
    words = ["Retrieval", "dense", "Graph", "net", "models"]
    names = [(b, rng.choice([" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), "x"]), i) for i in range(300) for b in ("entity", "alias")] + [("topic", None, 1), ("topic", "", 2)]
    topics = ["dense graph", "RETRIEVAL", "model", "net net", "zzz", "", None, "dense graph", "x"]
    got = fuzzy.similar_to(spark.createDataFrame([(t,) for t in topics], "topic string"), spark.createDataFrame(names, "bucket string, name string, id int"))
    want = set()
    for t in {t for t in topics if t}:
        for b in ("entity", "alias", "topic"):
            near = sorted((-int(fuzzy.ratio(t.lower(), n.lower()) + 1e-9), n, i) for bucket, n, i in names if bucket == b and n)
            want |= {(t, b, p, n, i, -r) for p, (r, n, i) in enumerate([x for x in near if x[0] <= -70][:5], 1)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10
