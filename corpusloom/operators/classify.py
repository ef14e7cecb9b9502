"""Classification results: picks by number or by new name against a taxonomy, memberships, and what needs review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import sanitize_domain

MOST_SHOWN = 30


def numbered(taxonomy: DataFrame) -> DataFrame:
    """domain, domain_index, collection, index: the numbers a classifier sees; at most 30 collections of a domain are shown."""
    d = Window.orderBy("domain")
    domains = taxonomy.select("domain").distinct().withColumn("domain_index", F.row_number().over(d) - 1)
    own = taxonomy.filter("collection is not null").withColumn("index", F.row_number().over(Window.partitionBy("domain").orderBy("collection")) - 1).filter(F.col("index") < MOST_SHOWN)
    return domains.join(own, "domain", "left")


def decide(results: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """slug, domain, collection, place, is_primary, needs_review: a row for each pick that stands.

    results: slug, domain_index (-1: new), new_domain, picks array<struct<index, new_name>>. A new domain's name is made plain, and one
    that is there already is that one; picks by number hold in the result's domain only; a new collection's name that is there already is that one. A pick
    with neither is left out, as is one that repeats an earlier one. The first is primary. A new domain or collection needs review.
    """
    seen = numbered(taxonomy)
    domains = seen.select("domain_index", F.col("domain").alias("known")).distinct()
    own = results.join(F.broadcast(domains), "domain_index", "left").withColumn("domain", F.coalesce("known", sanitize_domain(F.col("new_domain")))).filter("domain <> ''")
    held = domains.select(F.col("known").alias("domain")).withColumn("is_known", F.lit(True))
    own = own.join(F.broadcast(held), "domain", "left")
    picks = own.select("slug", "domain", "is_known", F.posexplode("picks").alias("place", "pick")).select("slug", "domain", "is_known", "place", F.col("pick.index").alias("index"), F.trim(F.col("pick.new_name")).alias("new_name"))
    by_number = seen.select("domain", "index", F.col("collection").alias("c1"))
    by_name = taxonomy.filter("collection is not null").select("domain", F.lower("collection").alias("low"), F.col("collection").alias("c2")).distinct()
    found = picks.join(by_number, ["domain", "index"], "left").withColumn("low", F.lower("new_name")).join(by_name, ["domain", "low"], "left")
    found = found.withColumn("collection", F.coalesce("c1", "c2", F.when(F.col("new_name") != "", F.col("new_name")))).filter("collection is not null")
    found = found.withColumn("fresh", F.col("c1").isNull() & F.col("c2").isNull() | F.col("is_known").isNull())
    once = found.withColumn("n", F.row_number().over(Window.partitionBy("slug", F.lower("collection")).orderBy("place"))).filter("n = 1")
    w = Window.partitionBy("slug")
    return once.withColumns({"is_primary": F.row_number().over(w.orderBy("place")) == 1, "needs_review": F.max("fresh").over(w)}).select("slug", "domain", "collection", "place", "is_primary", "needs_review")
