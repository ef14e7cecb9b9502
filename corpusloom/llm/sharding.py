"""Two-pass external shuffle: rows are scattered by seeded hashes into memory-sized buckets, each bucket is Fisher-Yates shuffled and written.

The buckets one after the other are a random order of all rows. Shards are equal ranges of it, so their counts of rows differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import keep

#: Hash cells that buckets are made of; their counts are all that goes to the driver.
CELL_BITS = 20


def numbered(docs: DataFrame) -> DataFrame:
    """(row, file, at): each row as a struct under its file's name and its place there, which no split, core count or retry changes.

    Rows that do not come straight from files that know these places are written to the shared folder first.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    at = (F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    try:
        return docs.select(row, *at)
    except AnalysisException:
        return keep(docs, "unsharded").select(row, *at)


def order_of(bucket: int, n: int, seed: int) -> np.ndarray:
    """A bucket's Fisher-Yates shuffle: position j gets row order[j] of its rows in hash order."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


def shuffle(docs: DataFrame, path: str, shards: int = 16, seed: int = 0, bucket_bytes: int = 8 << 20, partition_bytes: int = 256 << 20) -> DataFrame:
    """Write all rows in the seed's random order to path/shard=N; returns them as (row, slot, shard), row a struct of the columns of docs.

    Pass one counts rows and bytes by hash cell. A bucket is a range of cells of about bucket_bytes; there are at most 2^20, so beyond 2^20 times
    bucket_bytes they grow (about 95 MB at 100 TB). Pass two shuffles rows once, to partitions of whole buckets in order, sorted by hash; a task holds
    one bucket at a time. The hash is of the row's file and place, never of its id or text: copies and repeated ids spread like any other rows. The same files
    and seed give the same order on any cluster; within a shard, files follow each other in slot order, and reading can resume at any slot.

    Null texts, ids or other values are kept as they are. A row larger than a bucket is held whole. Columns may have any names, as they are inside `row`.
    An empty table writes no shard and gives no rows. path must not exist.
    """
    spark = docs.sparkSession
    hashed = numbered(docs).withColumn("hash", F.xxhash64(F.lit(seed).cast("long"), "file", "at"))
    cell = F.shiftrightunsigned("hash", 64 - CELL_BITS)
    wide = [f"row.`{f.name}`" for f in docs.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    size = F.lit(64).cast("long")
    for c in wide:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    cells = hashed.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).toArrow()
    at, n = (cells.column(c).to_numpy().astype(np.int64) for c in ("cell", "n"))
    total, rows = int(cells.column("bytes").to_numpy().sum()) if len(cells) else 0, int(n.sum())
    buckets = int(min(1 << CELL_BITS, max(1, -(-total // bucket_bytes))))
    partitions = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // partition_bytes)))
    counts = np.zeros(buckets, np.int64)
    np.add.at(counts, at * buckets >> CELL_BITS, n)
    begins = spark.sparkContext.broadcast(np.cumsum(counts) - counts)
    shard_begins = np.array([s * rows // shards for s in range(shards)], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed(bucket: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().column("row")
            order = order_of(bucket, len(rows), seed)
            slot = begins.value[bucket] + np.arange(len(order))
            shard = np.searchsorted(shard_begins, slot, side="right") - 1
            table = pa.Table.from_arrays([rows.take(pa.array(order)), pa.array(slot - shard_begins[shard]), pa.array(shard.astype(np.int32))], names=["row", "slot", "shard"])
            yield from table.to_batches(max_chunksize=10_000)

        now, held = None, []
        for batch in batches:
            own = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if own[lo] != now:
                        if held:
                            yield from placed(now, held)
                        now, held = int(own[lo]), []
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from placed(now, held)

    bucket = F.shiftright(cell * buckets, CELL_BITS)
    scattered = hashed.select("row", bucket.cast("int").alias("bucket"), "hash", "at")
    dealt = scattered.repartitionById(partitions, F.expr(f"cast(bucket * {partitions}L div {buckets} as int)")).sortWithinPartitions("bucket", "hash", "at").select("row", "bucket")
    schema = T.StructType([hashed.schema["row"], T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    dealt.mapInArrow(place, schema).sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return read(spark, path, schema)


def read(spark, path: str, schema: T.StructType, shard: int | None = None, first_slot: int = 0) -> DataFrame:
    """Rows of all shards or one, from a slot on; files before the slot are skipped by their statistics."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.filter((F.lit(shard is None) | (F.col("shard") == shard)) & (F.col("slot") >= first_slot))


def digests(placed: DataFrame, law: str = "rows") -> DataFrame:
    """Places, sizes and checksums, read from the shards; a null text has no bytes."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return placed.select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
