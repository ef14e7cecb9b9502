from collections import defaultdict

import pytest

from corpusloom.llm.bpe import tokenizer
from corpusloom.llm.queries import bpe_path
from corpusloom.llm.rollups import Ledger, count_tokens


def totals(ledger):
    return {tuple(r)[:3]: (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def test_batches_apply_once_and_add_up(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert totals(ledger) == {} and ledger.batches() == []
    first = frame(spark, [(1, "a", "x", "t1", 10), (2, "a", "x", "t1", 5), (3, None, None, "t1", None), (4, "b", "x", "t1", 7), (4, "b", "x", "t1", 7), (None, "b", "y", "t1", 2)])
    assert ledger.apply("one", inserts=first)
    want = {("a", "x", "t1"): (2, 15), (None, None, "t1"): (1, 0), ("b", "x", "t1"): (2, 14), ("b", "y", "t1"): (1, 2)}
    assert totals(ledger) == want
    assert not ledger.apply("one", inserts=first) and totals(ledger) == want
    ids = spark.createDataFrame([(4,), (4,), (99,), (None,)], "doc_id long")
    assert ledger.apply("two", deletes=ids, revised=frame(spark, [(1, "a", "x", "t2", 12), (50, "c", "x", "t2", 1)]))
    want = {("a", "x", "t1"): (1, 5), (None, None, "t1"): (1, 0), ("b", "y", "t1"): (1, 2), ("a", "x", "t2"): (1, 12), ("c", "x", "t2"): (1, 1)}
    assert totals(ledger) == want
    assert ledger.apply("three", deletes=ids.limit(0)) and ledger.apply("four") and totals(ledger) == want
    assert Ledger(spark, str(tmp_path)).batches() == ["four", "one", "three", "two"]
    with pytest.raises(ValueError):
        ledger.apply("../x")


def test_a_crash_between_the_steps_is_made_good(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    rows = frame(spark, [(1, "a", "x", "t1", 10)])
    real = ledger._publish

    def broken(df, kind, name):
        if kind == "totals":
            raise OSError("lost")
        real(df, kind, name)

    ledger._publish = broken
    with pytest.raises(OSError):
        ledger.apply("one", inserts=rows)
    assert totals(ledger) == {} and ledger.batches() == []
    ledger._publish = real
    assert ledger.apply("one", inserts=rows) and totals(ledger) == {("a", "x", "t1"): (1, 10)}


def test_query_equals_plain_python(spark, sf):
    from corpusloom.llm.queries import op10_token_rollups

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    toxic, low = ({r["doc_id"] for r in labels if r[c] == v} for c, v in (("toxic", 1), ("quality", 0)))
    bpe, want = tokenizer(bpe_path()), defaultdict(lambda: [0, 0])
    for d in docs:
        if d["doc_id"] not in toxic:
            own = want[d["source"], d["lang"], "byte_bpe_50k" + ("+end" if d["doc_id"] in low else "")]
            own[0] += 1
            own[1] += len(bpe.ids(d["text"])) + (d["doc_id"] in low)
    got = {tuple(r)[:3]: [r["n_docs"], r["n_tokens"]] for r in op10_token_rollups(spark, sf).collect()}
    assert got == dict(want)


def test_counts_of_hard_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "x " * 90_000)], "doc_id long, text string")
    got = sorted(map(tuple, count_tokens(df, bpe_path(), carry=["doc_id"]).collect()))
    bpe = tokenizer(bpe_path())
    assert got == [(1, 0), (2, 0), (3, len(bpe.ids("a b"))), (3, len(bpe.ids("a b"))), (4, len(bpe.ids("x " * 90_000)))]
