"""What a page of hits shows besides: topics, entities, figures and the linked repository of each source, by four reads that are held to the page's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources import shared

PAGE_MOST, PREVIEW = 50, 5


def held_to(child: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows of a page's keys; as a list of literals the filter reaches the scan and its row groups."""
    return child.filter(F.col(key).isin(wanted))


def _first(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= most)


def enrich(hits: DataFrame, key: str, topics: DataFrame, aliases: DataFrame, terms: DataFrame, figures: DataFrame, repos: DataFrame, preview: int = PREVIEW) -> DataFrame:
    """hits with topics (array, sorted), entities (array of name, type: the first by type and name), figures (count, first_caption by number) and repo (or null).

    hits: a page, of at most PAGE_MOST keys. topics: key, topic. aliases: key, term_id. terms: term_id, term_type, entity_type, canonical_name. figures: key,
    number, caption. repos: key, slug, url. Sources without any have empty arrays, a count of 0, null. Null keys are enriched with nothing; of several repositories the first slug stands.
    """
    spark, path = hits.sparkSession, shared.fresh_path(hits.sparkSession, "page")
    hits.write.parquet(path)  # so that the search runs once
    hits = spark.read.schema(hits.schema).parquet(path)
    wanted = sorted(r[0] for r in hits.select(key).filter(F.col(key).isNotNull()).distinct().limit(PAGE_MOST + 1).collect())
    if len(wanted) > PAGE_MOST:
        raise ValueError(f"a page of {PAGE_MOST} sources at most is enriched")
    of = lambda df: held_to(df, key, wanted)
    said = of(topics).groupBy(key).agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    named = of(aliases).select(key, "term_id").distinct().join(terms.filter("term_type = 'entity'"), "term_id").select(key, F.coalesce("entity_type", F.lit("")).alias("type"), F.col("canonical_name").alias("name"), "term_id")
    entities = _first(named, key, [F.col("type"), F.col("name"), F.col("term_id")], preview).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "name", "type"))).alias("e"))
    entities = entities.select(key, F.transform("e", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))).alias("entities"))
    shown = of(figures).groupBy(key).agg(F.struct(F.count("*").alias("count"), F.min(F.struct("number", "caption"))["caption"].alias("first_caption")).alias("figures"))
    linked = of(repos).groupBy(key).agg(F.min(F.struct("slug", "url")).alias("repo"))
    for part in (said, entities, shown, linked):
        hits = hits.join(F.broadcast(part), key, "left")  # at most a row for each key of the page
    none = F.struct(F.lit(0).cast("long").alias("count"), F.lit(None).cast("string").alias("first_caption"))
    return hits.withColumns({"topics": F.coalesce("topics", F.array().cast("array<string>")), "entities": F.coalesce("entities", F.array().cast("array<struct<name:string,type:string>>")), "figures": F.coalesce("figures", none)})


def topics_in(topics: DataFrame, members: DataFrame, collection: str) -> DataFrame:
    """topic, n and counts by kind of the bindings of a collection's members; both tables have kind and id."""
    own = topics.join(members.filter(F.col("collection") == collection).select("kind", "id").distinct(), ["kind", "id"], "left_semi")
    kinds = [F.sum((F.col("kind") == k).cast("long")).alias(f"{k}_n") for k in ("paper", "post", "repo")]
    return own.groupBy("topic").agg(F.count("*").alias("n"), *kinds)
