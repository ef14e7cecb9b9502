import random
import re
import zlib
from collections import Counter

from corpusloom.llm import spelling
from corpusloom.llm.queries import op12_spelling_variants


def counted(docs, every=199, least_length=6, least_n=5):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_n}


def edits(word, alphabet):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + c + b for a, b in cut for c in alphabet} | {a + c + b[1:] for a, b in cut if b for c in ["", *alphabet]}


def brute(words):
    alphabet = sorted({c for w in words for c in w})
    out = {}
    for w, n in words.items():
        close = sorted((-words[x], x) for x in edits(w, alphabet) if x in words and x != w)
        form = close[0][1] if close and -close[0][0] >= 5 * n else None
        out[w] = (form, n, len(close), words[form] if form else None)
    rows = set()
    for w, (form, n, near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, near, form_n))
    return rows


def got(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)


def test_dictionary(spark):
    docs = [(i % 40, "Straße naïve BECAUSE because beCause ÀÉÈabc ×÷×÷×÷ x1abcdefg2 日本語because-because " * (i % 3)) for i in range(80)]
    docs += [(None, "because receive" * 3), (None, None), (3, ""), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for every in (199, 3):
        assert {r["word"]: r["n"] for r in spelling.dictionary(df, every=every).collect()} == counted(docs, every=every)
    assert spelling.dictionary(df.limit(0)).count() == 0


def test_long_texts_are_cut_between_runs(monkeypatch):
    data = ("abcdef Àbcdéfg 日本 " * 500).encode()
    assert b"".join(spelling._pieces(data, 64)) == data and len(list(spelling._pieces(data, 64))) > 50
    for most in (1, 7, 64):
        assert Counter(w for p in spelling._pieces(data, most) for w in spelling.RUN.findall(p)) == Counter(spelling.RUN.findall(data))


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    words = {}
    while len(words) < 900:
        base = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words[base] = rng.choice([5, 5, 6, 25, 26, 130, 700])
    assert got(spelling.variants(frame(spark, words))) == brute(words)
    chain = {"aaaaaa" + "b" * i: 5 * 5**i for i in range(8)}
    assert got(spelling.variants(frame(spark, chain))) == brute(chain)


def test_crowded_blocks_lose_no_pair(spark):
    """One beginning and one ending hold most words; blocks of two words are subdivided down to gaps of one code point."""
    rng = random.Random(6)
    words = {f"common{''.join(rng.choice('xyz') for _ in range(rng.randint(1, 5)))}": rng.choice([5, 25, 125]) for _ in range(400)}
    words |= {f"{''.join(rng.choice('xyz') for _ in range(rng.randint(1, 5)))}ending": rng.choice([5, 25, 125]) for _ in range(400)}
    words |= {f"common{c}{d}ending": 9 for c in "abcdef" for d in "abcdef"}
    df = frame(spark, words)
    assert got(spelling.variants(df)) == brute(words)
    kept = spelling.candidates
    try:
        spelling.candidates = lambda w: kept(w, most=2)
        assert got(spelling.variants(df)) == brute(words)
        blocks = kept(df, most=2).groupBy(*spelling.KEY).count().filter("count > 2 and m - p - s > 1")
        assert blocks.count() == 0
    finally:
        spelling.candidates = kept


def test_hard_rows(spark):
    assert got(spelling.variants(frame(spark, {"nothing": 5}))) == {("nothing", None, "nothing", 5, 0, None)}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    long = {"y" * 50_000: 5, "y" * 50_001: 25, "y" * 25_000 + "z" + "y" * 25_000: 7}
    assert got(spelling.variants(frame(spark, long))) == brute_long(long)
    docs = spark.createDataFrame([(1, "because " * 6, "clash", 1)], "doc_id string, text string, word string, n int")
    assert [tuple(r) for r in spelling.dictionary(docs).collect()] == [("because", 6)]


def brute_long(words):
    (a, b, c) = words
    return {(a, b, b, 5, 2, 25), (b, None, b, 25, 2, None), (c, None, c, 7, 2, None)}


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_spelling_variants(spark, sf)) == brute(counted(docs))
