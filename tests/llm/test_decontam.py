import random
import re
import time
from itertools import combinations

import pytest

from corpusloom.llm import decontam
from corpusloom.llm.decontam import MASKS, Index, drop_contaminated, find_overlaps, needed, words


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_best(doc, item):
    """Most matched words of any stretch of any alignment of which four fifths agree."""
    most = 0
    for shift in range(-len(item), len(doc)):
        same = [0 <= i + shift < len(doc) and doc[i + shift] == word for i, word in enumerate(item)]
        if sum(same) > most:
            for b in range(len(item)):
                for e in range(b + 1, len(item) + 1):
                    if 5 * sum(same[b:e]) >= 4 * (e - b) and 0 <= b + shift and e + shift <= len(doc):
                        most = max(most, sum(same[b:e]))
    return most


def test_words_and_places():
    texts = ["Ab, cé-D2 ", None, "", "naïve_X"]
    w = words(texts)
    assert [texts[t][s:e].lower() for t, s, e in zip(w.text, w.start, w.end, strict=True)] == ["ab", "cé", "d2", "naïve", "x"]
    assert words(["ab xx", "q ab"]).hashes[0] == words(["ab xx", "q ab"]).hashes[3]


@pytest.mark.parametrize("n, want", [(5, 5), (9, 9), (10, 8), (15, 12), (17, 13), (60, 13)])
def test_needed(n, want):
    assert needed(n) == want


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n))) for i, n in enumerate([12, 15, 20, 30, 59, 6])]
    return items, spark.createDataFrame([*items, (77, None), (78, ""), items[2], (None, "null item words one two three four five six seven eight nine ten")], "item_id long, text string")


def test_planted_and_clean(spark, bench):
    items, table = bench
    rng = random.Random(5)
    filler = lambda n: [f"f{rng.randint(0, 5000)}" for _ in range(n)]
    docs, want = [], set()
    for k in range(120):
        item, text = items[k % 5]
        said = text.split()
        n = len(said)
        for p in rng.sample(range(1, n - 1), n // 6 if k % 2 else 0):
            said[p] = "replaced"
        docs.append((k, " ".join([*filler(k), *(w.upper() + "!!" if k % 3 else w for w in said), *filler(10)])))
        want.add((k, item))
    docs += [(500, " ".join(filler(300))), (501, None), (502, ""), (503, " ".join(items[4][1].split()[:8])), (504, "word " * 50_000 + items[5][1]), (505, items[1][1]), (505, items[1][1]), (None, items[1][1]), (506, "x null item words one two three four five six seven eight nine ten")]
    want |= {(504, 5), (505, 1), (None, 1), (506, None)}
    df = spark.createDataFrame([(*d, "a") for d in docs], "doc_id long, text string, item_id string")
    rows = find_overlaps(df, table).collect()
    texts = dict(docs)
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    assert sum(r["doc_id"] == 505 for r in rows) == 2
    for r in rows:
        if r["doc_id"] is not None and r["item_id"] is not None:
            item = plain_words(dict(items)[r["item_id"]])
            assert r["matched"] == plain_best(plain_words(texts[r["doc_id"]])[-400:], item)
            assert len(plain_words(texts[r["doc_id"]][r["start"] : r["end"]])) == r["words"]
    kept = drop_contaminated(df, table)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {500, 501, 502, 503}
    assert find_overlaps(df.limit(0), table).count() == 0 and find_overlaps(df, table.limit(0)).count() == 0


def test_query_finds_what_brute_force_finds(spark, sf):
    from corpusloom.llm.queries import op4_decontamination

    docs = {r["doc_id"]: plain_words(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: plain_words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for d, said in docs.items():
        known = set(said)
        for i, item in items.items():
            if sum(w in known for w in item) >= needed(len(item)) and plain_best(said, item) >= needed(len(item)):
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in op4_decontamination(spark, sf).collect()}
    assert got == want and got


def test_masks_meet_every_allowed_pattern_of_replaced_words():
    hit = lambda p, n, mask: any(all(p[s + i] for i, c in enumerate(mask) if c == "1") for s in range(n - len(mask) + 1))
    for agreed in range(5, 15):
        for n in range(agreed, (agreed * 5 // 4 if agreed >= 8 else agreed) + 1):
            for gone in combinations(range(1, n - 1), n - agreed):
                p = [i not in gone for i in range(n)]
                assert any(hit(p, n, m) for m in MASKS), p


def test_short_items_stand_whole(spark):
    items = spark.createDataFrame([(1, "qed"), (2, "to be or not"), (3, "alpha beta"), (4, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "thus QED."), (2, "to be, or not; to be"), (3, "to be or knot"), (4, "alpha gamma beta"), (5, "one two three four"), (6, "x one two three four five")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["words"]) for r in find_overlaps(docs, items).collect()} == {(1, 1, 1), (2, 2, 4), (6, 4, 5)}


def test_blocks_of_the_benchmark_give_the_same_rows(spark, bench, monkeypatch):
    items, table = bench
    docs = spark.createDataFrame([(i, f"f1 f2 {t} f3") for i, t in items], "doc_id long, text string")
    want = sorted(map(tuple, find_overlaps(docs, table).collect()))
    whole = decontam.indexes
    monkeypatch.setattr(decontam, "indexes", lambda b, i, t: whole(b, i, t, 200))
    assert sorted(map(tuple, find_overlaps(docs, table).collect())) == want and len(want) == len(items)
    assert drop_contaminated(docs, table).count() == 0


def test_one_word_repeated_stays_bounded():
    began = time.time()
    got = Index.of([1], ["word " * 800]).overlaps(["word " * 8000, "word " * 12, "w " * 900])
    assert [(t, i, n, m) for t, i, _, _, n, m in got] == [(0, 0, 800, 800)] and time.time() - began < 20
