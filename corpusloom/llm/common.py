"""Helpers that the operators share: shared-folder tables, input splits, bounded slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        found = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(found)
        return shared_dir(spark)
    return found


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/corpusloom/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input with fewer splits than cores over all cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, most: int = 50_000, least: int = 1_000) -> DataFrame:
    """Inner join of rows to `keyed`, which has one row a key and in `n` the number of rows with it (dropped).

    Keys that stand in more than a `most`-th of the rows (and in over `least` of them) are broadcast: no more than `most` can, whatever the tables'
    size. Their rows stay where they lie; only the others, none of them hot, are shuffled by key.
    """
    limit = keyed.agg(F.greatest(F.lit(least).cast("long"), F.expr(f"sum(n) div {most}"))).scalar()
    hot = F.broadcast(keyed.filter(F.col("n") > limit).drop("n"))
    rest = rows.join(F.broadcast(keyed.filter(F.col("n") > limit).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(keyed.filter(F.col("n") <= limit).drop("n"), key))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that `column` (string) holds about most_bytes in each; a longer value is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, lo = np.cumsum(sizes), 0
        while lo < batch.num_rows:
            base = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, base + most_bytes, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lengths[i]-1 of every i, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
