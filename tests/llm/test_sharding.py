import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import sharding
from corpusloom.llm.queries import op11_external_shuffle

NAMES = "doc_id long, text string, slot int, shard string, hash long, row int"


def rows(n):
    return [(None if i % 7 == 0 else i % 11, None if i % 5 == 0 else "x" * (i % 40) if i % 3 else "same", i, "s", i, None) for i in range(n)]


def places(df):
    return sorted((r["shard"], r["slot"], tuple(r["row"])) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "t")
    spark.createDataFrame(rows(500), NAMES).repartition(3).write.parquet(path)
    return path


def law_holds(got, n, shards):
    slots = defaultdict(list)
    for shard, slot, _ in got:
        slots[shard].append(slot)
    assert all(v == list(range(len(v))) for v in slots.values())
    assert sorted(len(slots[s]) for s in range(shards)) == sorted((n + s) // shards for s in range(shards))


def test_every_row_once_in_near_equal_shards(spark, stored, tmp_path):
    docs = spark.read.parquet(stored)
    got = places(sharding.shuffle(docs, str(tmp_path / "a"), shards=7, seed=1, bucket_bytes=2_000))
    law_holds(got, 500, 7)
    assert sorted(map(repr, (r for *_, r in got))) == sorted(map(repr, rows(500)))


def test_order_depends_on_seed_and_files_only(spark, stored, tmp_path):
    docs = spark.read.parquet(stored)
    args = {"shards": 5, "bucket_bytes": 3_000}
    first = places(sharding.shuffle(docs, str(tmp_path / "a"), seed=1, **args))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        assert places(sharding.shuffle(spark.read.parquet(stored), str(tmp_path / "b"), seed=1, partition_bytes=5_000, **args)) == first
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert places(sharding.shuffle(docs, str(tmp_path / "c"), seed=2, **args)) != first


def test_the_method_step_by_step(spark, stored, tmp_path):
    """Buckets are ranges of the hash; each is shuffled by its own seed and follows the one before."""
    docs = spark.read.parquet(stored)
    held = sharding.numbered(docs).selectExpr("row", "xxhash64(3L, file, at) as h", "at").collect()
    held.sort(key=lambda r: (r["h"] % (1 << 64), r["at"]))
    total = sum(64 + len((r["row"]["text"] or "").encode()) + 1 for r in held)
    buckets = -(-total // 4_000)
    by = defaultdict(list)
    for r in held:
        by[(r["h"] % (1 << 64) >> 44) * buckets >> 20].append(tuple(r["row"]))
    want = [by[b][i] for b in range(buckets) for i in sharding.order_of(b, len(by[b]), 3)]
    got = places(sharding.shuffle(docs, str(tmp_path / "a"), shards=4, seed=3, bucket_bytes=4_000))
    assert [r for *_, r in got] == want


def test_fisher_yates_is_uniform():
    seen = defaultdict(int)
    for seed in range(6000):
        seen[tuple(sharding.order_of(0, 3, seed))] += 1
    assert len(seen) == 6 and max(seen.values()) - min(seen.values()) < 250
    assert sorted(sharding.order_of(5, 1000, 1)) == list(range(1000))
    assert abs(np.corrcoef(sharding.order_of(5, 1000, 1), np.arange(1000))[0, 1]) < 0.15


def test_reading_resumes_at_a_slot(spark, stored, tmp_path):
    path = str(tmp_path / "a")
    placed = sharding.shuffle(spark.read.parquet(stored), path, shards=3, seed=1)
    whole = places(placed.filter("shard = 1"))
    assert places(sharding.read(spark, path, placed.schema, shard=1, first_slot=100)) == whole[100:]


def test_hard_rows(spark, tmp_path):
    empty = sharding.shuffle(spark.createDataFrame([], NAMES), str(tmp_path / "e"))
    assert empty.count() == 0 and sharding.digests(empty).count() == 0
    long = "é" * 3_000_000
    docs = spark.createDataFrame([(1, long, 0, "", 0, 0), (1, None, 0, "", 0, 0), (None, "", 0, "", 0, 0), (2, "ab", 0, "", 0, 0)], NAMES).unionAll(spark.createDataFrame([(2, "ab", 0, "", 0, 0)] * 60, NAMES))
    got = sharding.digests(sharding.shuffle(docs.distinct().unionAll(docs), str(tmp_path / "h"), shards=16, bucket_bytes=1_000))
    found = got.collect()
    assert len(found) == 68 and sorted(got.groupBy("shard").count().toPandas()["count"]) == [4] * 12 + [5] * 4
    assert {(r["size"], r["text_crc32"]) for r in found} == {(6_000_001, zlib.crc32(long.encode())), (1, 0), (3, zlib.crc32(b"ab"))}


def test_query_covers_documents(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op11_external_shuffle(spark, sf).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs.items())
    law_holds(sorted((r["shard"], r["slot"], None) for r in got), len(docs), 16)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
