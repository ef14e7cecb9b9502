import math

import numpy as np
import pytest

from corpusloom.llm.topk import Block, Pivots, top_k


def plain(rows, asked, k):
    """Every row is a candidate but those of the query's own id; each query row has its own ranks."""
    usable = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if asked(i):
            best = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j) for j, w in usable if j != i and len(w) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("in_block", [8192, 7])
def test_equals_brute_force(spark, in_block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.1]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(500, None), (501, []), (502, [1.0, None] * 4), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (505, [0.5, 0.25]), (506, [0.25, 0.75]), (None, rows[0][1]), (50, rows[9][1]), (50, rows[9][1]), (507, [0.0] * 8), (550, [3e7] * 8), (600, []), (601, rows[9][1]), (601, rows[9][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    asked = lambda i: i % 50 == 0 or i in (501, 505, 507)
    queries = df.filter("vec_id % 50 = 0 or vec_id in (501, 505, 507)")
    assert sorted(map(tuple, top_k(queries, df, 5, n_pivots=6, queries_in_block=in_block, pivot_sample=100).collect())) == plain(rows, asked, 5)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(df.filter("vec_id = 0"), df).collect()] == [(0, 1, 1, 128 * 256)]
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0


def test_bounds_leave_most_candidates_unscored():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 200
    c = np.floor(centres[np.arange(4000) % 20] + rng.normal(size=(4000, 16)) * 4).astype(np.int64)
    ids = np.arange(4000)
    pivots = Pivots(c[:20].astype(float), ids[:200], c[:200].astype(float))
    block = Block(np.arange(10), ids[:10], c[:10], pivots, 5)
    for lo in range(0, 4000, 1000):
        block.see(ids[lo : lo + 1000], c[lo : lo + 1000], pivots.table(c[lo : lo + 1000].astype(float)))
    for i in range(10):
        s = c @ c[i]
        assert block.best[i][0].tolist() == sorted(set(range(4000)) - {i}, key=lambda j: (-s[j], j))[:5]
    assert block.scored < 0.1 * 10 * 4000
