"""Ingest of so many sources that their slugs run out, against the SQL."""

import duckdb
from pyspark.sql import functions as F

from corpusloom.queries import QUERIES, SQL


def test_sources_whose_slug_is_in_use_stay_as_they_are_when_forced(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        own = spark.read.parquet(f"{sf}/{name}.parquet").filter("doc_id < 60")
        for k in (100_000, 200_000):  # shifted so, a document makes the same two slugs as its copy
            own = own.unionByName(own.filter("doc_id < 60").withColumn("doc_id", F.col("doc_id") + k))
        own.dropDuplicates(["doc_id"]).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["ingest_stages"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(db.sql(f"SELECT {', '.join(got.columns)} FROM ({SQL['ingest_stages']})").fetchall(), key=repr)
    assert got.filter("error like 'slug in use%'").count() > 0
