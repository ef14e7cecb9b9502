"""Corpus entities: sources, sections, READMEs, memberships, terms and citation edges, read from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.segments import Segments
from corpusloom.sources.shared import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, id, slug, title, date, domain, collection: each document a paper."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.lit("paper").alias("kind"), F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), "doc_id").alias("slug"), F.substring_index("text", ".", 1).alias("title"), F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("doc_id", F.lit(2000)).cast("int")).alias("date"), F.col("lang").alias("domain"), F.col("source").alias("collection"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections_of(table(spark, sf_dir, "documents"))


def sections_of(docs: DataFrame) -> DataFrame:
    """key, slug, domain, section_title, section_level, body: a section for each line that isn't blank."""
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("ord", "body")).filter(F.trim("body") != "")
    return lines.select((F.col("doc_id") * 1_000_000 + F.col("ord")).alias("key"), F.concat(F.lit("doc_"), "doc_id").alias("slug"), F.col("lang").alias("domain"), F.concat(F.lit("line "), "ord").alias("section_title"), (1 + F.col("ord") % 3).alias("section_level"), "body")


def readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("rag"), F.lit("vision"), F.lit("agents"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.concat(F.lit("gh-lab-"), "item_id").alias("slug"), F.element_at(names, (F.col("item_id") % 3 + 1).cast("int")).alias("domain"), F.col("text").alias("body"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, id, collection, of orders: a target may be in several collections."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("collection")).distinct()


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_brand").alias("domain"), F.substring_index("p_type", " ", 1).alias("term_type"), F.col("p_name").alias("canonical_name"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, ref_number, cited: citation edges of orders to parts; every tenth part can't be told."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("ref_number"), F.when(F.col("l_partkey") % 10 != 0, F.col("l_partkey")).alias("cited"))


SECTION_COLUMNS = ["domain", "slug", "section_title", "section_level", "body"]
README_COLUMNS = ["domain", "slug", "body"]
_saved: dict[tuple[str, str, str], Segments] = {}


def saved_index(spark: SparkSession, sf_dir: str, surface: str) -> Segments:
    """The index of a folder's sections, readmes or terms: built in the shared folder at its first use in an application, read from there afterwards, and built again if the folder was cleaned up."""
    kinds = {"sections": ("key", "slug", SECTION_COLUMNS, sections), "readmes": ("key", "slug", README_COLUMNS, readmes), "terms": ("term_id", "term_id", ["domain", "term_type", "canonical_name"], terms)}
    key, owner, columns, rows = kinds[surface]
    name = (spark.sparkContext.applicationId, sf_dir, surface)
    if name not in _saved or not _saved[name].intact():
        own = Segments(spark, fresh_path(spark, f"index-{surface}"), key, owner, columns)
        own.rebuild(rows(spark, sf_dir))
        _saved[name] = own
    return _saved[name]
