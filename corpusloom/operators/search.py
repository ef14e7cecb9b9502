"""Ranked search over sections and READMEs: filters, recency, grouping, paging, and fusion of several queries."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.index import Index, bm25
from corpusloom.plans.parser import Parsed, QueryError, parse

E_FOLD_DAYS, RRF_K, FUSED_MOST, QUERIES_MOST = 730, 60, 50, 8


def since_date(text: str) -> datetime.date:
    """YYYY or an ISO date."""
    if re.fullmatch(r"\d{4}", text):
        return datetime.date(int(text), 1, 1)
    try:
        return datetime.date.fromisoformat(text)
    except ValueError as e:
        raise QueryError(f"since: {text}") from e


def recency(score: Column, date: Column, boost: float, as_of: datetime.date) -> Column:
    """The score times 1 + boost * exp(-age / 730 days); no date, no boost. Scores are negative, so more is better."""
    return score * (1 + boost * F.coalesce(F.exp(F.datediff(date, F.lit(as_of)) / F.lit(float(E_FOLD_DAYS))), F.lit(0.0)))


def recency_steps(score: Column, date: Column, boost: float, as_of: datetime.date) -> Column:
    """The same by steps, where no exponential is to be had: 1 in the first year, a half in the next two, a tenth later; no date, no boost."""
    days = F.datediff(F.lit(as_of), date)
    return score * (1 + boost * F.when(date.isNull(), 0.0).when(days < 365, 1.0).when(days < 1095, 0.5).otherwise(0.1))


def ranked(index: Index, rows: DataFrame, query: str | Parsed, sources: DataFrame | None = None, members: DataFrame | None = None, boost: float = 0.0, since: str | None = None, as_of: datetime.date | None = None, keep_undated: bool = False) -> DataFrame:
    """Matching rows with score and rank (from 1), best first, ties by key.

    rows: the indexed rows with slug, domain. sources: slug, date (for boost and since). members: slug, collection (primary or not).
    Scores come from the whole index; domain:, paper: and collection: only filter.
    """
    own = parse(query) if isinstance(query, str) else query
    if own.node is None:
        raise QueryError("no words to search for")
    hits = bm25(index, own.node).join(rows, index.key)
    if paper := own.qualifiers.get("paper"):
        hits = hits.filter(F.col("slug") == paper)
    if domain := own.qualifiers.get("domain"):
        hits = hits.filter(F.col("domain") == domain)
    if collection := own.qualifiers.get("collection"):
        hits = hits.join(members.filter(F.col("collection") == collection).select("slug"), "slug", "left_semi")
    if boost or since:
        hits = hits.join(sources.select("slug", "date"), "slug", "left")
    if since:
        late = F.col("date") >= F.lit(since_date(since))
        hits = hits.filter(late | F.col("date").isNull() if keep_undated else late)
    if boost:
        hits = hits.withColumn("score", recency(F.col("score"), F.col("date"), boost, as_of))
    # rounded, so that sums taken in another order rank alike
    return hits.withColumn("score", F.round("score", 9))


def page(hits: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset+1 .. offset+limit in order of score and key, with their rank; a top-k, never a global sort."""
    top = hits.orderBy("score", key).limit(offset + limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("score", key))).filter(F.col("rank") > offset)


def grouped(paged: DataFrame, columns: list[str]) -> DataFrame:
    """Hits by slug: hit_count, best rank, and the hits' columns in rank order."""
    return paged.groupBy("slug").agg(F.count("*").alias("hit_count"), F.min("rank").alias("best_rank"), F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("hits"))


def with_fallback(search, query: str) -> tuple[DataFrame, str | None]:
    """search(parsed) and None; or, where bare words match nothing at all, the words joined by OR and "OR"."""
    own = parse(query)
    found = search(own)
    if own.fallback is None or not found.isEmpty():
        return found, None
    return search(Parsed(own.fallback, own.qualifiers)), "OR"


def flattened(paged: DataFrame) -> DataFrame:
    """A page's hits ranked anew after grouping: sources by their best hit, each source's hits in a row. A page is a few rows."""
    best = F.min("rank").over(Window.partitionBy("slug"))
    own = paged.withColumn("best", best)
    return own.withColumn("rank", F.row_number().over(Window.orderBy("best", "rank"))).drop("best")


def fuse(lists: list[tuple[int, DataFrame]], cap: int = FUSED_MOST) -> DataFrame:
    """Reciprocal rank fusion of (query number, list of (item, rank)): item, fused score, and the numbers of the queries that found it.

    A query may have several lists, one for each surface, ranked on their own. An item that a list holds more than once counts each time.
    """
    if len({q for q, _ in lists}) > QUERIES_MOST:
        raise QueryError(f"at most {QUERIES_MOST} queries")
    union = None
    for q, own in lists:
        part = own.select("item", "rank", F.lit(q).alias("q"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("item").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 12).alias("fused"), F.array_join(F.transform(F.sort_array(F.collect_set("q")), lambda x: x.cast("string")), ",").alias("matched_queries"))
    top = fused.orderBy(F.desc("fused"), "item").limit(cap)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fused"), "item")))
