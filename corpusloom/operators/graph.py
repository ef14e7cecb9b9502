"""Citation graph: resolving edges, outbound buckets, inbound pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(references: DataFrame, known: DataFrame) -> DataFrame:
    """Edges with cited_id filled where the cited source is known; forward and backward resolution are one join.

    references: src, ref_number, cited. known: cited, cited_id. A citation of the source itself counts.
    """
    return references.join(known, "cited", "left")


def bucket(resolved: DataFrame) -> DataFrame:
    """Adds bucket: resolved, missing (named but not held) or unresolvable (not named)."""
    return resolved.withColumn("bucket", F.when(F.col("cited_id").isNotNull(), "resolved").when(F.col("cited").isNotNull(), "missing").otherwise("unresolvable"))


def outbound(resolved: DataFrame, most: int = 500) -> DataFrame:
    """Per source the counts of each bucket over its first `most` references (by ref_number, then cited and cited_id; nulls last), and whether there are more."""
    w = Window.partitionBy("src").orderBy(*map(F.asc_nulls_last, ("ref_number", "cited", "cited_id")))
    own = bucket(resolved).withColumn("place", F.row_number().over(w))
    kept = F.col("place") <= most
    per = [F.count(F.when(kept & (F.col("bucket") == b), 1)).alias(b) for b in ("resolved", "missing", "unresolvable")]
    return own.groupBy("src").agg(*per, (F.count("*") > most).alias("truncated"))


def inbound(resolved: DataFrame, citing: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """cited_id, src, date, place: distinct citing sources of each cited one, newest first, then by number; one page of each."""
    edges = resolved.filter("cited_id is not null").select("cited_id", "src").distinct().join(citing, "src")
    w = Window.partitionBy("cited_id").orderBy(F.desc_nulls_last("date"), "src")
    return edges.withColumn("place", F.row_number().over(w)).filter((F.col("place") > offset) & (F.col("place") <= offset + limit)).select("cited_id", "src", "date", "place")
