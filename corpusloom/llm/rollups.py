"""Token counts as delta-maintained rollups: signed document counts by batch, additive totals, each batch committed once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.bpe import tokenizer
from corpusloom.llm.common import slices, spread

KEYS = ("source", "lang", "tokenizer")
LOG = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizer_path: str, text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of `carry` and n_tokens of each whole text; a null text has none."""
    columns = carry if carry is not None else ["doc_id", "source", "lang"]
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for batch in slices(batches, "__text"):
            n = np.fromiter((len(bpe.ids(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=schema.names)

    return spread(docs.select(*columns, F.col(text_column).alias("__text"))).mapInArrow(run, schema)


class Ledger:
    """Batches of signed counts under one folder; a batch is visible when its folder stands under its name, which a rename does at once.

    log/<batch>: a row for each document, source, lang and tokenizer: n_docs and n_tokens, signed.
    totals/<batch>: the batch's sums by source, lang and tokenizer. All totals are sums over batches, a few rows each.

    A batch is committed once its totals stand; apply() does nothing for it then, and does all anew for one that a crash left half done, so a
    batch may be sent again and again.
    One writer at a time; readers see whole batches only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, kind: str) -> list[str]:
        fs, p = self._at(kind)
        return sorted(n for s in (fs.listStatus(p) if fs.exists(p) else []) if not (n := s.getPath().getName()).startswith((".", "_")))

    def _publish(self, df: DataFrame, kind: str, name: str) -> None:
        """Write under a hidden name, then rename; what a crash left under the hidden name is written over."""
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}/_new-{name}")
        fs, new = self._at(f"{kind}/_new-{name}")
        if not fs.rename(new, self._at(f"{kind}/{name}")[1]):
            raise OSError(f"could not publish {kind}/{name}")

    def batches(self) -> list[str]:
        """Names of committed batches."""
        return self._names("totals")

    def _read(self, kind: str, schema: str, only: list[str] | None = None) -> DataFrame:
        names = [n for n in self._names(kind) if only is None or n in only]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{kind}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """Net counts by document and key; rows that sum to nothing are gone."""
        return self._read("log", LOG, self.batches()).groupBy("doc_id", *KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def apply(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: DataFrame | None = None) -> bool:
        """Commit a batch once; False if it is committed already.

        inserts: doc_id, source, lang, tokenizer, n_tokens, a document each (repeated rows count each). deletes: doc_id; all that the id
        has is taken back. revised: like inserts, but what the id had is taken back first, once however often it is repeated; an id that has nothing is only
        added. Ids in deletes or revised that are null or unknown take nothing back. Null sources, languages or tokenizers are a key of
        their own; null counts are 0. Other columns are not read.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches():
            return False
        plus = lambda df: df.select("doc_id", *KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
        parts = [plus(df) for df in (inserts, revised) if df is not None]
        gone = [df.select("doc_id") for df in (deletes, revised) if df is not None]
        if gone:
            ids = gone[0] if len(gone) == 1 else gone[0].union(gone[1])
            parts.append(self.current().join(ids.distinct(), "doc_id", "left_semi").select("doc_id", *KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))
        if not parts:
            parts = [self.spark.createDataFrame([], LOG)]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        fs, left = self._at(f"log/{batch}")
        fs.delete(left, True)
        self._publish(rows, "log", batch)
        own = self.spark.read.schema(LOG).parquet(f"{self.path}/log/{batch}")
        sums = own.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        self._publish(sums.coalesce(1), "totals", batch)
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches; keys whose counts are 0 are left out."""
        rows = self._read("totals", "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")
