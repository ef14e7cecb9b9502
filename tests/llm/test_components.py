import random

from test_common_shingles import sent
from test_simhash import roots

from corpusloom.llm.components import components

PAIRS = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 200), (-5, 300), (300, 300), (300, -5), (7, 7)] + [(None, 3), (4, None), (None, None), (120, 121)]
WANT = {i: 0 for i in range(41)} | {100 + k: 100 for k in range(50)} | {200: 200, -5: -5, 300: -5}


def found(spark, pairs, **few):
    rows = components(spark.createDataFrame(pairs, "u long, v long"), **few).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["root"] for r in rows}


def test_one_task_and_rounds_give_the_same(spark):
    rng = random.Random(5)
    n, edges = 300, [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    want = roots(n, edges)
    least = {}
    for i, r in enumerate(want):
        least[r] = min(least.get(r, i), i)
    for few in ({}, {"few": 0}):
        assert found(spark, PAIRS, **few) == WANT
        assert found(spark, [], **few) == {} and found(spark, [(None, 1)], **few) == {}
        assert found(spark, edges, **few) == {i: least[want[i]] for e in edges for i in e}
    assert found(spark, PAIRS, few=len(PAIRS) - 4) == found(spark, PAIRS, few=len(PAIRS) - 3) == WANT


def test_few_links_take_a_fixed_number_of_stages(spark):
    rng = random.Random(6)
    names = rng.sample(range(1 << 40), 2000)
    links = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "u long, v long")
    since = sent(spark, 0)[1]
    got = components(links).collect()
    assert sent(spark, since)[1] - since <= 8
    assert sorted(map(tuple, got)) == sorted((x, min(names)) for x in names)
