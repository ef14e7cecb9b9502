"""The folder that the driver and all executors share, and names in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; where neither is set, a temporary one on a local master and an error on a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        return shared_dir(spark)
    return held.get().rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{what}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path and the path as it wants it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def commit_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that appears whole or not at all; an error where there is one already."""
    fs, p = file_system(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{p.getParent().toString()}/_new-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    none = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    kinds = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = none
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, p, kinds)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, without hidden ones, sorted; none where there is no folder."""
    fs, p = file_system(spark, path)
    return sorted(n for s in (fs.listStatus(p) if fs.exists(p) else []) if not (n := s.getPath().getName()).startswith((".", "_")))
