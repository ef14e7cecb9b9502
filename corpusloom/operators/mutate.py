"""Changes as new tables: insert-or-ignore, upsert, replace-all, cascades, orphan collection, propagation, invariants.

Plain Parquet has no transactions, so each operation returns the new table; publish() swaps it in, and a
store.Store commits several at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_or_ignore(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """held and the rows of new whose key isn't there; of new rows with one key, the least stands."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)) if rest else new.distinct()
    return held.unionByName(first.join(held.select(*keys), keys, "left_anti").select(*held.columns))


def upsert(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, new values that aren't null replace held ones."""
    rest = [c for c in held.columns if c not in keys]
    a, b = held.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.join(b, on, "full_outer").select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in rest))


def replace_all(held: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """All rows of the owners that new has are replaced by new's."""
    return held.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def delete_sources(tables: dict[str, DataFrame], gone: DataFrame, kind: str) -> dict[str, DataFrame]:
    """Cascade: the sources gone (kind, id) and all that hangs on them; inbound citations stay, unresolved; catalog and terms stay.

    tables may hold: sources, sections, figures, memberships, topics (kind, id, ...), references (src, ref_number, cited, cited_id; of papers).
    """
    own = gone.filter(F.col("kind") == kind).select("kind", "id").distinct()
    out = {n: t.join(own, ["kind", "id"], "left_anti") for n, t in tables.items() if n != "references"}
    if "references" in tables:
        ids = own.select(F.col("id").alias("gone_id"))
        refs = tables["references"].join(ids, F.col("src") == F.col("gone_id"), "left_anti")
        marked = refs.join(ids, F.col("cited_id") == F.col("gone_id"), "left")
        out["references"] = marked.withColumn("cited_id", F.when(F.col("gone_id").isNull(), F.col("cited_id"))).drop("gone_id")
    return out


def collect_orphans(terms: DataFrame, bindings: DataFrame, on: list[str]) -> DataFrame:
    """Terms that some binding names."""
    return terms.join(bindings.select(*on).distinct(), on, "left_semi")


def propagate(members: DataFrame, links: DataFrame) -> DataFrame:
    """Memberships of papers passed on to their linked repos (paper_id, repo_id), replacing what those had."""
    passed = members.filter("kind = 'paper'").join(links, F.col("id") == F.col("paper_id")).select(F.lit("repo").alias("kind"), F.col("repo_id").alias("id"), "collection", "is_primary")
    kept = members.join(links.select(F.lit("repo").alias("kind"), F.col("repo_id").alias("id")), ["kind", "id"], "left_anti")
    return kept.unionByName(passed)


def two_primaries(members: DataFrame) -> DataFrame:
    """Targets with more than one primary membership; must be empty."""
    return members.groupBy("kind", "id").agg(F.sum(F.col("is_primary").cast("int")).alias("n")).filter("n > 1")


def shared_slugs(slugs: DataFrame) -> DataFrame:
    """Slugs that aren't of a-z 0-9 _ or occur twice; must be empty."""
    return slugs.groupBy("slug").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | ~F.col("slug").rlike("^[a-z0-9_]+$"))


def soft_duplicates(rows: DataFrame, key: str, hash_column: str) -> DataFrame:
    """key and n of rows whose content hash another row has too. Counted first, so that a very common hash is not gathered."""
    again = rows.groupBy(hash_column).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(again, hash_column).select(key, "n")


def publish(df: DataFrame, path: str) -> None:
    """Write beside the table, then swap the folders by two renames; a reader between them finds no table. Where that matters, or tables change together, use store.Store."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(f"{path}.old"), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(f"{path}.old"))
    if not fs.rename(at(f"{path}.new"), at(path)):
        raise OSError(f"could not publish {path}")
