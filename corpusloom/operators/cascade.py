"""Deletes that follow the keys between tables: counted first, then all tables changed in one commit.

Each table is marked in one pass: left joins to the keys that its parents lose say which rows go and which columns become null. Only buckets with such rows
are written again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources import shared
from corpusloom.sources.store import Store


@dataclass(frozen=True)
class Edge:
    """child.column names parent.key; `kind` restricts a child that holds children of several parents; null: the column is emptied instead of the row deleted."""

    child: str
    column: str
    parent: str
    key: str = "id"
    kind: str | None = None
    null: bool = False


#: Parents before their children's own children: a table's edges are all known when it is marked.
EDGES = (
    Edge("repos", "paper_id", "papers"),
    Edge("references", "paper_id", "papers"),
    Edge("references", "cited_paper_id", "papers", null=True),
    Edge("figures", "paper_id", "papers"),
    Edge("sections", "slug", "papers", "slug"),
    Edge("sections", "slug", "posts", "slug"),
    Edge("post_references", "post_id", "posts"),
    Edge("post_references", "cited_paper_id", "papers", null=True),
    Edge("members", "target_id", "papers", kind="paper"),
    Edge("members", "target_id", "posts", kind="post"),
    Edge("members", "target_id", "repos", kind="repo"),
    Edge("topics", "target_id", "papers", kind="paper"),
    Edge("topics", "target_id", "posts", kind="post"),
    Edge("topics", "target_id", "repos", kind="repo"),
    Edge("code_files", "repo_id", "repos"),
    Edge("readmes", "repo_id", "repos"),
    Edge("aliases", "source", "papers", "slug"),
    Edge("aliases", "source", "posts", "slug"),
    Edge("aliases", "term_id", "terms"),
    Edge("vectors", "term_id", "terms"),
)


def _mark(rows: DataFrame, edges: list[Edge], lost: dict[str, DataFrame]) -> DataFrame:
    """rows with `dead` and, for each column to be emptied, `empty_<column>`."""
    dead, empty = F.lit(False), {}
    for i, e in enumerate(edges):
        keys = lost[e.parent].select(F.col(e.key).alias(f"key{i}")).filter(F.col(f"key{i}").isNotNull()).distinct()
        named = F.col(e.column) == F.col(f"key{i}")
        rows = rows.join(keys, named & (F.col("target_kind") == e.kind) if e.kind else named, "left")
        hit = F.col(f"key{i}").isNotNull()
        if e.null:
            empty[e.column] = empty.get(e.column, F.lit(False)) | hit
        else:
            dead = dead | hit
    columns = [c for c in rows.columns if not c.startswith("key")]
    return rows.select(*columns, dead.alias("dead"), *((~dead & hit).alias(f"empty_{c}") for c, hit in empty.items()))


def _kept(store: Store, parent: str, dead: DataFrame) -> DataFrame:
    """The keys that a parent loses, worked out once and written to the shared folder: every edge and both passes read them there."""
    rows = dead.select(*sorted({e.key for e in EDGES if e.parent == parent})).distinct()
    return _written(store, f"lost-{parent}", rows)


def _written(store: Store, what: str, rows: DataFrame) -> DataFrame:
    path = shared.fresh_path(store.spark, what)
    rows.write.parquet(path)
    return store.spark.read.schema(rows.schema).parquet(path)


def plan(store: Store, root: str, gone: DataFrame, topics_too: bool = True) -> tuple[dict[str, DataFrame], dict[str, dict]]:
    """(marked rows, counts) of each table that deleting `gone` (the root table's key columns, `id` at least) touches, without changing anything.

    counts: deleted, emptied and the buckets that hold such rows. With topics_too, topics of terms that no source is bound to go, and with them their
    aliases and vectors. Ids that are unknown or null delete nothing.
    """
    held = [n for n in store.snapshot()["tables"]]
    marked: dict[str, DataFrame] = {}
    own = store.read(root, bucketed=True)
    ids = gone.select(F.col("id").alias("key0")).filter("key0 is not null").distinct()
    marked[root] = own.join(ids, F.col("id") == F.col("key0"), "left").withColumn("dead", F.col("key0").isNotNull()).drop("key0")
    parents = {e.parent for e in EDGES}
    lost = {root: _kept(store, root, marked[root].filter("dead"))}
    order = list(dict.fromkeys(e.child for e in EDGES))
    for child in [c for c in order if c not in ("aliases", "vectors")] + ["terms", "aliases", "vectors"]:
        if child not in held or child in marked:
            continue
        if child == "terms":
            if topics_too and "topics" in marked:
                live = _written(store, "live", marked["topics"].filter("not dead").select(F.col("topic").alias("bound"), F.col("domain").alias("there")).distinct())
                mine = store.read("terms", bucketed=True).join(live, (F.col("canonical_name") == F.col("bound")) & (F.col("domain") == F.col("there")), "left")
                marked[child] = mine.withColumn("dead", (F.col("term_type") == "topic") & F.col("bound").isNull()).drop("bound", "there")
                lost[child] = _kept(store, child, marked[child].filter("dead"))
            continue
        edges = [e for e in EDGES if e.child == child and e.parent in lost]
        if edges:
            marked[child] = _mark(store.read(child, bucketed=True), edges, lost)
            if child in parents:
                lost[child] = _kept(store, child, marked[child].filter("dead"))
    counts = {}
    for name, rows in marked.items():
        empties = [c for c in rows.columns if c.startswith("empty_")]
        emptied = sum((F.col(c).cast("int") for c in empties), F.lit(0))
        by = rows.groupBy("in_bucket").agg(F.sum(F.col("dead").cast("int")).alias("deleted"), F.sum(emptied).alias("emptied")).filter("deleted + emptied > 0").collect()
        counts[name] = {"deleted": sum(r["deleted"] for r in by), "emptied": sum(r["emptied"] for r in by), "buckets": sorted(r["in_bucket"] for r in by)}
    return marked, counts


def delete(store: Store, root: str, gone: DataFrame, topics_too: bool = True) -> dict[str, dict[str, int]]:
    """Delete rows of the root table (papers, posts, repos) and what hangs on them in one commit; the counts taken before, by table.

    Inbound citations stay, their resolved id emptied. The catalog of collections and other terms stay.
    """
    marked, counts = plan(store, root, gone, topics_too)
    changes = {}
    for name, rows in marked.items():
        touched = counts[name]["buckets"]
        rows = rows.filter(F.col("in_bucket").isin(touched) & ~F.col("dead"))
        for c in [c for c in rows.columns if c.startswith("empty_")]:
            column = c.removeprefix("empty_")
            rows = rows.withColumn(column, F.when(~F.col(c), F.col(column)))
        changes[name] = (touched, rows)
    store.replace(changes)
    return {n: {k: c[k] for k in ("deleted", "emptied")} for n, c in counts.items()}


def wipe(store: Store, seed: dict[str, DataFrame] | None = None) -> dict[str, int]:
    """Empty every table in one commit, but for those that `seed` gives rows for; the counts of rows there were."""
    tables = store.snapshot()["tables"]
    counts = {n: store.read(n).count() for n in tables}
    seed = seed or {}
    store.create({n: ((seed[n] if n in seed else store.read(n).limit(0)), t["keys"]) for n, t in tables.items()})
    return counts
