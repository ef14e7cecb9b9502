import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.bpe import tokenizer
from corpusloom.llm.queries import bpe_path
from corpusloom.llm.training_order import materialise, permute, read


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_permutation_is_a_bijection_with_an_inverse(n):
    for key in (0, 1, 987654321, (1 << 64) - 1):
        got = permute(np.arange(n), n, key)
        assert sorted(got.tolist()) == list(range(n))
        assert permute(got, n, key, back=True).tolist() == list(range(n))
    assert n < 64 or permute(np.arange(n), n, 1).tolist() != permute(np.arange(n), n, 2).tolist()
    assert permute(np.array([0, 5]), 1 << 61, 3).max() < 1 << 61


def test_shards_hold_every_stream_in_slot_order(spark, tmp_path):
    texts = {1: None, 2: "", 3: "word " * 2000, 4: "same text", 5: "zwei  drei", 6: "x " * 37}
    rows = [*texts.items(), (4, "same text"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, slot int").repartition(3)
    out = str(tmp_path / "run")
    index, manifest = materialise(df, bpe_path(), out, key=7, stride=16, shard_rows=10)
    index, manifest = index.collect(), manifest.collect()
    n, top = len(index), out
    out = str(Path(manifest[0]["path"]).parent)
    assert sorted(r["slot"] for r in index) == sorted(r["ordinal"] for r in index) == list(range(n))
    held = dict(read(out, stride=16, shard_rows=10))
    assert sorted(held) == list(range(n))
    assert [s for s, _ in read(out, 23, stride=16, shard_rows=10)] == list(range(23, n))
    assert sorted((m["first_slot"], m["n_rows"]) for m in manifest) == [(k, min(10, n - k)) for k in range(0, n, 10)]
    stream = {}
    for r in index:
        ids = held[r["slot"]]
        assert (ids[r["n_ids"] :] == 2).all() and zlib.crc32(ids[: r["n_ids"]].tobytes()) == r["ids_crc32"]
        assert r["shard"] == r["slot"] // 10 and r["byte_offset"] == r["slot"] % 10 * 32
        stream[r["ordinal"]] = (ids[: r["n_ids"]].tolist(), r["doc_ids"])
    got = [i for o in sorted(stream) for i in stream[o][0]]
    said = [i for d in dict.fromkeys(x for o in sorted(stream) for x in stream[o][1]) for i in [d]]
    assert set(said) == {i for i, _ in rows}
    bpe = tokenizer(bpe_path())
    want = sorted(tuple(bpe.ids(t or "")) for _, t in rows)
    ends = np.flatnonzero(np.array(got) == 2)
    assert sorted(tuple(got[a + 1 : b]) for a, b in zip([-1, *ends[:-1]], ends, strict=True)) == want
    before = {m["path"]: m["crc32"] for m in manifest}
    again = {m["path"]: m["crc32"] for m in materialise(df, bpe_path(), top, key=7, stride=16, shard_rows=10)[1].collect()}
    assert again == before
    # another key or other documents in the same folder never meet the first run's files
    for other, key in ((df, 8), (df.withColumn("text", F.upper("text")), 7)):
        index, manifest = (x.collect() for x in materialise(other, bpe_path(), top, key=key, stride=16, shard_rows=10))
        assert not {m["path"] for m in manifest} & set(before)
        held = dict(read(str(Path(manifest[0]["path"]).parent), stride=16, shard_rows=10))
        assert all(zlib.crc32(held[r["slot"]][: r["n_ids"]].tobytes()) == r["ids_crc32"] for r in index)
        assert all(m["crc32"] == zlib.crc32(Path(m["path"]).read_bytes()) for m in manifest)
    assert all(zlib.crc32(Path(p).read_bytes()) == c for p, c in before.items())
    empty = materialise(df.limit(0), bpe_path(), str(tmp_path / "none"), key=1)
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_query_covers_all_documents(spark, sf):
    from corpusloom.llm.queries import op2_training_order

    rows = op2_training_order(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    bpe = tokenizer(bpe_path())
    assert sum(r["n_ids"] for r in rows) == sum(len(bpe.ids(d["text"])) + 1 for d in docs)
    assert {i for r in rows for i in r["doc_ids"]} == {d["doc_id"] for d in docs}
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
