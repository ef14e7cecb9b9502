"""Connected components of a link table: a bounded number of links in one task, more by alternating stars; no link or component goes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import hot_join, keep


def settle(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Union the pairs (u, v) into label, which points to the smallest member."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows (u, v) as (node, root)."""
    held = [b for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(2))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = np.arange(len(nodes))
        settle(label, at[: len(u)], at[len(u) :])
        kind = held[0].schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(nodes[label], kind)], names=["node", "root"])


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours go to its smallest; small star: its smaller neighbours and itself do.

    The smallest neighbour is a partial aggregate; it is joined back by hot_join, so a node with very many links is never gathered.
    """
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
    if large:
        moved = hot_join(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = hot_join(both, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, few: int = 1 << 20) -> DataFrame:
    """(node, root) of every node of links (u, v): root is the smallest node of its component.

    Up to `few` links meet in one task (16 MB of them by default): rounds would make over twenty small stages each, and the driver pays for every
    stage and task. More links go through alternating stars, where each round is written to the shared folder and rounds grow with the logarithm
    of the longest chain. Both are exact. Loops u = v count as a node on its own. Null ends are left out. No links: no rows.
    """
    links = keep(links.select("u", "v").filter("u is not null and v is not null"), "ends")
    if links.count() <= few:
        kind = links.schema["u"].dataType
        return keep(links.coalesce(1).mapInArrow(_joined, T.StructType([T.StructField("node", kind), T.StructField("root", kind)])), "components")
    edges = keep(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        turned = keep(_star(_star(edges, True), False), "edges")
        now = _mark(turned)
        edges = turned
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).unionByName(links.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("root")).join(stars.select("node").union(stars.select("root")).distinct(), "node", "left_anti").distinct())
