import random

import numpy as np
import xxhash

from corpusloom.llm.components import components
from corpusloom.llm.simhash import fingerprint, links, near_duplicates, trie_links


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_pairs(prints, budget):
    return [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= budget]


def clustered(rng, n, centres=5, bits=6):
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = {rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits))) for _ in range(n)}
    return sorted(out)


def test_fingerprint_follows_the_definition():
    for text in [None, "", " \t", "One", "one two", "A b c", "A B c d\ne\x0bf  g É\xa0h", "x " * 500, " wide space"]:
        assert fingerprint(text) == plain_fingerprint(text), text


def test_trie_links_find_the_components_of_all_near_pairs():
    for seed in range(8):
        rng = random.Random(seed)
        prints = clustered(rng, 600)
        keys = np.array(prints, np.uint64)
        for leaf in (1, 16, 256):
            label = trie_links(keys, np.zeros(len(keys), np.int64), keys, 3, leaf=leaf, most=500)
            assert label.tolist() == roots(len(prints), near_pairs(prints, 3))


def test_links_with_rerooted_hot_groups(spark):
    rng = random.Random(7)
    prints = sorted(set(clustered(rng, 1500, centres=2, bits=5)) | {rng.getrandbits(64) for _ in range(300)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    want = roots(len(prints), near_pairs(prints, 3))
    for most in (20_000, 50):
        place = {p - (1 << 64) if p >> 63 else p: i for i, p in enumerate(prints)}
        got = roots(len(prints), [(place[r["u"]], place[r["v"]]) for r in links(df, 3, most).collect()])
        assert got == want


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 200)] + [(None, 3), (120, 121)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(50)} | {200: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def want_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    own = roots(len(rows), near_pairs(prints, 3))
    least = {}
    for (i, _), r in zip(rows, own, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted((i if i is not None else -1, p, least.get(r) if least.get(r) is not None else -1) for (i, _), p, r in zip(rows, prints, own, strict=True))


def test_near_duplicates_hard_rows(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    rows = [(9, None), (5, ""), (7, " \n"), (3, "same old text here"), (2, "Same OLD text here"), (2, "same old text here"), (None, "alone again naturally"), (None, "same old text here"), (11, long), (4, long + " extra"), (8, "two words"), (6, "one")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, fp int")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"] % (1 << 64), r["component_id"] if r["component_id"] is not None else -1) for r in near_duplicates(df).collect())
    assert got == want_components(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf):
    from corpusloom.llm.queries import op8_simhash_near_dedup

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in op8_simhash_near_dedup(spark, sf).collect())
    assert got == want_components(rows)
