"""Tables that change together: files by bucket of a key, and a snapshot that names the files of all tables, switched at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources import shared


class Store:
    """tables/<name>/in_change=<id>/in_bucket=<n>: the rows of one bucket as one change wrote them; snapshots/<version>: for each table its schema, keys and where each bucket lies.

    A change writes the buckets it touches under a new id, then one snapshot. Readers see all of it or nothing; the highest version counts; of two writers of
    one version the second fails. What a crash leaves is named by no snapshot.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def snapshot(self) -> dict:
        found = shared.names(self.spark, f"{self.path}/snapshots")
        return json.loads(shared.read_text(self.spark, f"{self.path}/snapshots/{found[-1]}")) if found else {"version": 0, "tables": {}}

    def _bucket(self, keys: list[str]):
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def read(self, name: str, bucketed: bool = False, only: list[int] | None = None) -> DataFrame:
        """A table as it stands now; with bucketed, its bucket is the column in_bucket; only: these buckets."""
        table = self.snapshot()["tables"][name]
        schema = T.StructType.fromJson(table["schema"])
        paths = [f"{self.path}/tables/{name}/in_change={v}/in_bucket={b}" for b, v in table["parts"].items() if only is None or int(b) in only]
        if not paths:
            rows = self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("in_bucket", T.IntegerType())]))
        else:
            own = T.StructType([*schema.fields, T.StructField("in_change", T.StringType()), T.StructField("in_bucket", T.IntegerType())])
            rows = self.spark.read.schema(own).option("basePath", f"{self.path}/tables/{name}").parquet(*paths).drop("in_change")
        return rows if bucketed else rows.drop("in_bucket")

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Write rows (with their bucket) under a new id: where each bucket that has rows lies."""
        v = uuid.uuid4().hex
        at = f"{self.path}/tables/{name}/in_change={v}"
        rows.hint("rebalance", "in_bucket").write.partitionBy("in_bucket").parquet(at)
        return {n.removeprefix("in_bucket="): v for n in shared.names(self.spark, at) if n.startswith("in_bucket=")}

    def _commit(self, held: dict, tables: dict) -> None:
        version = held["version"] + 1
        shared.commit_text(self.spark, f"{self.path}/snapshots/{version:012d}.json", json.dumps({"version": version, "tables": held["tables"] | tables}))

    def create(self, tables: dict[str, tuple[DataFrame, list[str]]]) -> None:
        """Set tables to the rows given, each with the keys that deal it to buckets; others stay."""
        held, new = self.snapshot(), {}
        for name, (rows, keys) in tables.items():
            new[name] = {"schema": rows.schema.jsonValue(), "keys": keys, "parts": self._write(name, rows.withColumn("in_bucket", self._bucket(keys)))}
        self._commit(held, new)

    def replace(self, changes: dict[str, tuple[list[int], DataFrame]]) -> int:
        """In one commit, give each table new rows for the buckets named; rows must come with their bucket. Returns how many buckets were written."""
        held, new = self.snapshot(), {}
        for name, (buckets, rows) in changes.items():
            if buckets:
                table = held["tables"][name]
                kept = {b: v for b, v in table["parts"].items() if int(b) not in set(buckets)}
                fields = [f["name"] for f in table["schema"]["fields"]]
                new[name] = table | {"parts": kept | self._write(name, rows.select(*fields, "in_bucket"))}
        if new:
            self._commit(held, new)
        return sum(len(b) for b, _ in changes.values())

    def merged(self, name: str, rows: DataFrame, keys: list[str]) -> tuple[list[int], DataFrame]:
        """For replace(): rows put in place of those with the same keys. The table's own keys must be among them. rows is read more than once."""
        own = rows.withColumn("in_bucket", self._bucket(self.snapshot()["tables"][name]["keys"]))
        buckets = sorted(r["in_bucket"] for r in own.select("in_bucket").distinct().collect())
        held = self.read(name, bucketed=True, only=buckets).join(own.select(*keys).distinct(), keys, "left_anti")
        return buckets, held.unionByName(own.select(*held.columns))

    def without(self, name: str, keys: DataFrame) -> tuple[list[int], DataFrame]:
        """For replace(): the table without the rows whose columns of the same names are in keys."""
        held = self.read(name, bucketed=True)
        buckets = sorted(r["in_bucket"] for r in held.join(keys.distinct(), keys.columns, "left_semi").select("in_bucket").distinct().collect())
        return buckets, held.filter(F.col("in_bucket").isin(buckets)).join(keys.distinct(), keys.columns, "left_anti")

    def vacuum(self) -> int:
        """Delete what the newest snapshot doesn't name; how many folders. Readers of older snapshots must be done."""
        held, n = self.snapshot(), 0
        for name, table in held["tables"].items():
            for v in shared.names(self.spark, f"{self.path}/tables/{name}"):
                live = {b for b, at in table["parts"].items() if f"in_change={at}" == v}
                for bucket in shared.names(self.spark, f"{self.path}/tables/{name}/{v}"):
                    if bucket.removeprefix("in_bucket=") not in live:
                        fs, p = shared.file_system(self.spark, f"{self.path}/tables/{name}/{v}/{bucket}")
                        fs.delete(p, True)
                        n += 1
        return n
