"""Taxonomy views: browse lists, overview tree, collections, coverage counts, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collection_counts(members: DataFrame) -> DataFrame:
    """collection, n, and its place by count, then name."""
    own = members.groupBy("collection").agg(F.count("*").alias("n"))
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "collection")))


def topic_counts(bindings: DataFrame, kinds: list[str]) -> DataFrame:
    """topic, n, and one count for each kind, from distinct bindings (kind, id, topic)."""
    per = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k.lower()}") for k in kinds]
    return bindings.distinct().groupBy("topic").agg(F.count("*").alias("n"), *per)


def overview(sources: DataFrame) -> DataFrame:
    """domain, collection, n: a row for each collection, and one for each domain with a null collection; empty ones don't occur.

    A source counts for its domain unless it is attached to another one (column attached), but always for its collection, so the
    two levels are counted apart.
    """
    alone = sources.filter(~F.col("attached")).groupBy("domain").agg(F.count("*").alias("n")).select("domain", F.lit(None).cast("string").alias("collection"), "n")
    return alone.unionByName(sources.groupBy("domain", "collection").agg(F.count("*").alias("n")))


KINDS = ("paper", "post", "repo")


def _by_kind(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in KINDS))


def tree(domains: DataFrame, definitions: DataFrame, sources: DataFrame, members: DataFrame) -> DataFrame:
    """domain, collection, n_paper, n_post, n_repo of every domain (null collection) and every collection that is defined, empty ones with zeros.

    domains: domain. definitions: domain, collection. sources: kind, id, domain. members: kind, id, domain, collection; each counts once. The two levels are
    counted apart, as a source is in several collections or in none.
    """
    top = domains.join(_by_kind(sources, "domain"), "domain", "left").withColumn("collection", F.lit(None).cast("string"))
    low = definitions.join(_by_kind(members.distinct(), "domain", "collection"), ["domain", "collection"], "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS]
    return top.select("domain", "collection", *counts).unionByName(low.select("domain", "collection", *counts))


def collection_totals(members: DataFrame, limit: int) -> DataFrame:
    """domain, collection, counts by kind, and by kind whether a page of `limit` leaves some out."""
    own = _by_kind(members.distinct(), "domain", "collection")
    return own.select("*", *((F.col(f"n_{k}") > limit).alias(f"more_{k}") for k in KINDS))


def distinct_terms(mentions: DataFrame, key: str) -> DataFrame:
    """key, n_terms: how many different terms each source names."""
    return mentions.groupBy(key).agg(F.countDistinct("term").alias("n_terms"))


def diversity(results: DataFrame) -> DataFrame:
    """kind, n, first_slots: how often search results (query, rank, kind) are of a kind, and in how many queries the first is."""
    first = results.groupBy("query").agg(F.min_by("kind", "rank").alias("kind")).groupBy("kind").agg(F.count("*").alias("first_slots"))
    return results.groupBy("kind").agg(F.count("*").alias("n")).join(first, "kind", "left").select("kind", "n", F.coalesce("first_slots", F.lit(0).cast("long")).alias("first_slots"))


def top_collections(sources: DataFrame, most: int) -> DataFrame:
    """domain, collection, n, place, overflow: the `most` largest collections of each domain and how many more there are."""
    counts = sources.groupBy("domain", "collection").agg(F.count("*").alias("n"))
    w = Window.partitionBy("domain")
    out = counts.withColumns({"place": F.row_number().over(w.orderBy(F.desc("n"), "collection")), "overflow": F.greatest(F.count("*").over(w) - most, F.lit(0))})
    return out.filter(F.col("place") <= most)


def collection_detail(sources: DataFrame, names: list[str], limit: int) -> DataFrame:
    """domain, collection, slug, date, place, total, truncated: newest first, of each named collection in each domain."""
    w = Window.partitionBy("domain", "collection")
    own = sources.filter(F.col("collection").isin(names)).select("domain", "collection", "slug", "date")
    out = own.withColumns({"place": F.row_number().over(w.orderBy(F.desc_nulls_last("date"), "slug")), "total": F.count("*").over(w)})
    return out.filter(F.col("place") <= limit).withColumn("truncated", F.col("total") > limit)


def missing_names(sources: DataFrame, names: DataFrame) -> DataFrame:
    """Names asked for that no source is in."""
    return names.join(sources.select(F.col("collection").alias("name")), "name", "left_anti")


def preview(rows: DataFrame, key: str, order: list[str], most: int = 5) -> DataFrame:
    """The first `most` rows of each key by `order`, with their place and the key's total."""
    w = Window.partitionBy(key)
    return rows.withColumns({"place": F.row_number().over(w.orderBy(*order)), "total": F.count("*").over(w)}).filter(F.col("place") <= most)
