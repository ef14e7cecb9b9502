"""Topics whose likest names are a letter away are settled by deletions, the others are compared with all names; both give what all pairs give."""

import random

import pytest

from corpusloom.operators import fuzzy


@pytest.mark.parametrize("lengths", [(9,), (8, 9), (7, 8, 9, 11)])
def test_settled_topics_equal_all_pairs(spark, monkeypatch, lengths):
    rng = random.Random(sum(lengths))
    monkeypatch.setattr(fuzzy, "NAMES", 40)
    monkeypatch.setattr(fuzzy, "BLOCK", 7)
    word = lambda: f"{rng.choice(['Item#', 'item#'])}{rng.randrange(300):0{rng.choice(lengths) - 5}d}"
    names = [(b, word(), i) for i in range(400) for b in ("alias", None)] + [("few", w, i) for i, w in enumerate(("Item#0001", "graph net", "é", "", None, "item#0001"))]
    topics = [*{word() for _ in range(30)}, "graph net", "GRAPH  net", "x", "", None, "item#", "itme#0100"]
    got = fuzzy.similar_to(spark.createDataFrame([(t,) for t in topics], "topic string"), spark.createDataFrame(names, "bucket string, name string, id int"))
    want = set()
    for t in {t for t in topics if t}:
        for b in ("alias", None, "few"):
            near = sorted((-int(fuzzy.ratio(t.lower(), n.lower()) + 1e-9), n, i) for bucket, n, i in names if bucket == b and n)
            want |= {(t, b, p, n, i, -r) for p, (r, n, i) in enumerate([x for x in near if x[0] <= -70][:5], 1)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_few_topics_are_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "NAMES", 500)
    names = spark.createDataFrame([("alias", f"Customer#{i:06d}", i) for i in range(2000)], "bucket string, name string, id int")
    asked = names.filter("id % 50 = 0").selectExpr("name AS topic").distinct()
    near = fuzzy._near(asked.selectExpr("topic", "lower(topic) AS said"), names.selectExpr("'b' AS code", "bucket", "name", "lower(name) AS low"), 5)
    assert near.select("topic").distinct().count() == asked.count() == 40 and near.count() == 200
