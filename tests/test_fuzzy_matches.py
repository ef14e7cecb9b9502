"""The best match of each name against all pairs, where all names are alike, and topics by blocks."""

import random

from corpusloom.operators import fuzzy, resolve


def test_best_match_of_names_that_are_all_alike(spark, monkeypatch):
    rng = random.Random(4)
    terms = [(i, f"Customer#{i:06d}", rng.choice("de"), "t") for i in range(90)] + [(200, "a", "d", "t"), (201, "graph nets", "d", "t"), (202, "Graph  nets", "d", "t"), (203, None, "d", "t")]
    names = [(f"Customer#{i:06d}"[:-1], rng.choice("de"), "t") for i in range(0, 90, 3)] + [("graph net", "d", "t"), ("grahp nest", "d", "t"), ("a", "d", "t"), ("", "d", "t"), (None, "d", "t"), ("zzz", "e", "t")]
    want = {}
    for raw, d, k in {n for n in names if n[0] is not None}:
        for i, c, e, _ in terms:
            if d == e and c is not None and (raw[:1].lower() == c[:1].lower() or abs(len(raw) - len(c)) <= 3):
                r = fuzzy.ratio(resolve.plain_normal(raw), resolve.plain_normal(c))
                if r >= 85:
                    want[raw, d] = min(want.get((raw, d), (0.0, 0, 0)), (-r, len(c), i))
    frames = spark.createDataFrame(names, "raw string, domain string, term_type string"), spark.createDataFrame(terms, "term_id long, canonical_name string, domain string, term_type string")
    real, seen = resolve.similar_pairs, []
    monkeypatch.setattr(resolve, "similar_pairs", lambda a, b, least, scope: seen.extend(r["raw"] for r in a.select("raw").collect()) or real(a, b, least, scope))
    got = {(r["raw"], r["domain"]): (r["term_id"], round(r["ratio"], 9)) for r in resolve.fuzzy(*frames).collect()}
    assert got == {k: (i, round(-r, 9)) for k, (r, _, i) in want.items()}
    assert "grahp nest" in seen and len(seen) < len(names), "names with a form one letter apart are not compared with all that share bigrams"


def test_many_names_at_a_time_equal_one_by_one():
    import numpy as np

    rng = random.Random(6)
    lows = sorted({"".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 80))) for _ in range(200)})
    said = ["".join(rng.choice("abcdé z") for _ in range(n)) for n in (1, 2, 9, 30, 62, 63, 64, 75)] + lows[:5]
    i, j, alike = fuzzy._likest(said, np.zeros(len(lows), np.int64), lows, 40, 7)
    for t, a in enumerate(said):
        want = sorted((-int(fuzzy.ratio(a, b) + 1e-9), n) for n, b in enumerate(lows) if int(fuzzy.ratio(a, b) + 1e-9) >= 40)[:7]
        assert sorted((-s, y) for x, y, s in zip(i, j, alike, strict=True) if x == t) == want
