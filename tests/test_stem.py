"""Word stems against SQLite's porter tokenizer, and the term index that uses them."""

import random
import sqlite3

from corpusloom.functions.stem import stem
from corpusloom.operators import index, search
from corpusloom.plans.parser import parse

ENDS = "s es ies ed eed ing ational tional enci izer ation ator alism iveness fulness ousness aliti biliti icate ative alize ical ful ness al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize y e ll".split()


def test_stems_equal_sqlites():
    rng = random.Random(1)
    words = {"caresses", "ponies", "cats", "agreed", "plastered", "motoring", "hopping", "falling", "hissing", "fizzed", "filing", "sky", "happy", "relational", "conditional", "digitizer", "vietnamization", "hopefulness", "formality", "electrical", "adjustment", "adoption", "controlling", "roll", "retrieval", "retrieving", "embeddings", "networks", "generalizations"}
    for _ in range(3000):
        words.add("".join(rng.choice("bcdlmnrstvwxy") + rng.choice("aeiouy") for _ in range(rng.randint(1, 3))) + rng.choice(["", "t", "st", "ll", "ss", "n"]) + rng.choice(ENDS))
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    for i, w in enumerate(sorted(words)):
        db.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (i, w))
    want = dict(db.execute("SELECT doc, term FROM v"))
    got = {i: stem(w) for i, w in enumerate(sorted(words))}
    assert {w: (got[i], want[i]) for i, w in enumerate(sorted(words)) if got[i] != want[i]} == {}


def test_other_word_forms_find_a_term_and_buckets_prune(spark, tmp_path):
    rows = spark.createDataFrame([(1, "dense retrieval"), (2, "neural networks"), (3, "ranking")], "key long, name string").withColumn("slug", index.F.col("name"))
    own = index.build(rows, "key", ["name"], stemmed=True)
    own.save(str(tmp_path / "i"))
    held = index.Index.load(spark, str(tmp_path / "i"), "key", stemmed=True)
    for said, want in (("retrieving", [1]), ("network", [2]), ("ranked OR retrieve", [1, 3]), ("rank", [3])):
        for i in (own, held):
            assert sorted(r["key"] for r in search.ranked(i, rows, parse(said)).collect()) == want
    plan = index.occurrences(held, list(index.phrases(parse("networks").node)))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
