"""Gazetteer matches against a plain scan of all positions; the whole chain on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import entities


def brute(words, names):
    found = {(i, n, " ".join(words[i : i + n])) for i in range(len(words)) for n in range(1, entities.LONGEST + 1) if i + n <= len(words) and " ".join(words[i : i + n]) in names}
    return found, {a for a in found if not any(b[0] < a[0] + a[1] and a[0] < b[0] + b[1] and (b[1] > a[1] or (b[1] == a[1] and b[0] < a[0])) for b in found)}


def test_matches_equal_a_scan_of_all_positions(spark):
    rng = random.Random(8)
    words = ["dense", "passage", "retrieval", "graph", "of", "x"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 349, 350, 351, 700, 1100])))) for i in range(16)] + [(90, None), (91, ""), (92, "Dense! Passage—RETRIEVAL")]
    names = ["dense", "dense passage", "passage retrieval graph", "of of", "x x x x x x x x", "graph", "Rétrieval", "", "zzz", "one two three four five six seven eight nine"]
    df = spark.createDataFrame(docs, "id long, body string")
    own = spark.createDataFrame([(n, "model", 0.9) for n in names], "name string, label string, score double")
    held = {" ".join(r["w"]) for r in own.select(text.tokens(F.col("name")).alias("w")).collect()}
    found = entities.matches(df, "id", "body", own)
    got, best = ({(r["id"], r["start"], r["n"], r["phrase"]) for r in x.collect()} for x in (found, entities.longest(found, "id")))
    assert found.count() == len(got)
    for i, said in docs:
        every, longest = brute((said or "").lower().replace("!", "").replace("—", " ").split(), held)
        assert {x[1:] for x in got if x[0] == i} == every and {x[1:] for x in best if x[0] == i} == longest


@pytest.mark.parametrize("n", [0, 3])
def test_the_chain(spark, n):
    docs = spark.createDataFrame([(1, "Dense passage retrieval (DPR) beats BM25. DPR uses BERT, table 2."), (2, "DPR and BERT and bert model"), (3, None)][:n], "id long, body string")
    names = spark.createDataFrame([("DPR", "method", 0.9), ("dense passage retrieval", "method", 0.8), ("BERT", "model", 0.7), ("bert", "dataset", 0.5), ("BM25", "method", 0.3), ("table", "model", 0.9), ("BERT model", "model", 0.9)], "name string, label string, score double")
    got = {tuple(r) for r in entities.extract(docs, "id", "body", names).collect()}
    want = {(1, "dense passage retrieval", "method", 3), (1, "bert", "model", 1), (2, "dpr", "method", 1), (2, "bert", "model", 2)}
    assert got == (want if n else set())
