"""Exact top-k search by pivot-table elimination: stored distances to pivots bound every score, candidates are taken in bound order until none can enter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import keep, spread

#: Largest magnitude of a component with which all sums stay exact in doubles for up to 2^13 components.
EXACT = 1 << 20


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component; vectors that are null or hold null or non-finite components, and null ids, are left out."""
    x = F.col("x")
    usable = F.col("id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("x"))
    return rows.filter(usable).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


@dataclass
class Pivots:
    """Mutually far vectors of a bounded sample, and the sample: it gives each query a score that its k best reach at least."""

    pivots: np.ndarray
    ids: np.ndarray
    sample: np.ndarray

    def table(self, x: np.ndarray) -> np.ndarray:
        """Distances of the rows of x to each pivot."""
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * x @ self.pivots.T, 0))

    def fits(self, x: np.ndarray) -> bool:
        """Whether distances bound the scores of these rows exactly: the pivots' length, components small enough."""
        return len(self.pivots) > 0 and x.shape[1] == self.pivots.shape[1] <= 1 << 13 and np.abs(x).max(initial=0) <= EXACT


def choose_pivots(rows: DataFrame, n_pivots: int, sample: int) -> Pivots:
    """n_pivots vectors by farthest-first from the `sample` rows of smallest id hash (of their most common length)."""
    got = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).collect()
    sizes = pd.Series([len(r["v"]) for r in got if r["v"] and max(map(abs, r["v"])) <= EXACT], dtype="int64").value_counts()
    if not len(sizes):
        return Pivots(np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros((0, 0)))
    dim = max(sizes.index, key=lambda d: (sizes[d], -d))
    own = [r for r in got if len(r["v"]) == dim and max(map(abs, r["v"])) <= EXACT]
    x = np.array([r["v"] for r in own], np.float64)
    chosen, gap = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n_pivots, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return Pivots(x[chosen], np.array([r["id"] for r in own], np.int64), x)


class Block:
    """A bounded block of queries of one length, with each query's k best among the candidates seen so far."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, q: np.ndarray, pivots: Pivots, k: int):
        self.row, self.ids, self.q, self.k = row, ids, q, k
        self.exact = pivots.fits(q)
        self.floor = np.full(len(ids), -np.inf)  # a score that the k-th best has at least
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.scored = 0
        if self.exact:
            self.q2, self.table = (q.astype(np.float64) ** 2).sum(1), pivots.table(q.astype(np.float64))
            for i in range(len(ids)):
                scores = (pivots.sample @ q[i])[pivots.ids != ids[i]]
                if len(scores) >= k:
                    self.floor[i] = np.partition(scores, -k)[-k]

    def _enter(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.best[i][0], ids]), np.concatenate([self.best[i][1], scores])
        first = np.lexsort([ids, -scores])[: self.k]
        self.best[i] = ids[first], scores[first]
        if len(first) == self.k:
            self.floor[i] = max(self.floor[i], scores[first[-1]])

    def see(self, ids: np.ndarray, c: np.ndarray, table: np.ndarray | None, step: int = 64, coarse: int = 8) -> None:
        """Candidates with their stored distances to the pivots (None: every one is scored).

        For a pivot p, |d(q,p) - d(c,p)| <= d(q,c); the largest of these over the pivots turns into an upper bound of the inner product. All
        but those that a few pivots rule out are bounded by every pivot, and scored in falling order of the bound, until it is below the k-th best score.
        """
        if table is None or not self.exact:
            for i in range(len(self.ids)):
                other = ids != self.ids[i]
                self.scored += int(other.sum())
                self._enter(i, ids[other], c[other] @ self.q[i])
            return
        x, columns = c.astype(np.float64), np.ascontiguousarray(table.T)
        c2 = (x**2).sum(1)
        for i in range(len(self.ids)):
            left, low = np.flatnonzero(ids != self.ids[i]), None
            for lo, hi in ((0, coarse), (coarse, len(columns))):
                for p in range(lo, min(hi, len(columns))):
                    gap = np.abs(columns[p][left] - self.table[i, p])
                    low = gap if low is None else np.maximum(low, gap, out=low)
                loose = np.maximum(low - 1e-6 * (1 + low), 0)  # rounding only loosens the bound
                high = np.floor((self.q2[i] + c2[left] - loose * loose) / 2 + 1e-3)
                may = high >= self.floor[i]
                left, low, high = left[may], low[may], high[may]
            order = np.argsort(-high, kind="stable")
            for at in range(0, len(order), step):
                if high[order[at]] < self.floor[i]:
                    break
                own = left[order[at : at + step]]
                self.scored += len(own)
                self._enter(i, ids[own], np.rint(x[own] @ self.q[i]).astype(np.int64))

    def found(self) -> pa.RecordBatch:
        """(row, query_id, vec_id, score) of the best that can still be among the k best of all."""
        sizes = [len(b[0]) for b in self.best]
        ids, scores = (np.concatenate([np.zeros(0, np.int64), *(b[j] for b in self.best)]) for j in range(2))
        row, own, floor = (np.repeat(x, sizes) for x in (self.row, self.ids, self.floor))
        may = scores >= floor
        return pa.RecordBatch.from_arrays([pa.array(x[may]) for x in (row, own, ids, scores)], names=["row", "query_id", "vec_id", "score"])


def _by_length(v: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    sizes = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), d)


def pivot_table(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """The rows (id, v) with d, their distances to the pivots, null where these give no exact bound; written once."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away: list[list[float] | None] = [None] * batch.num_rows
            for at, x in _by_length(batch.column(1)):
                small = np.abs(x).max(1, initial=0) <= EXACT
                if held.value.fits(x[small]):
                    for i, d in zip(at[small].tolist(), held.value.table(x[small].astype(np.float64)).tolist(), strict=True):
                        away[i] = d
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away, pa.list_(pa.float64()))], names=["id", "v", "d"])

    return keep(rows.mapInArrow(run, "id long, v array<long>, d array<double>"), "pivot-table")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256, n_pivots: int = 32, pivot_sample: int = 4096, queries_in_block: int = 8192) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k best candidates by integer inner product of floor(scale * x), ties to the smaller id.

    The pivot table is computed once and stored beside the candidates. Queries are taken in blocks of bounded size, one broadcast at a
    time; candidates are never shuffled: each task runs through its part of the table and hands on the best that can still enter, at most k a query.
    Only the pivots' sample (pivot_sample rows) and a block of queries go to the driver. Results don't depend on pivots, sample or blocks.

    A candidate with the query's own id is left out. Vectors that are null or hold null or non-finite components take no part, nor do null ids;
    an empty vector has score 0 with other empty ones, and vectors of different lengths don't meet. Rows that repeat an id are
    candidates and queries each. Lengths other than the pivots' and components beyond 2^20 are scored without a bound. With fewer candidates
    than k all are returned. Empty tables give no rows. Other columns are not read. Inner products beyond 64 bits wrap.
    """
    spark = queries.sparkSession
    rows = keep(spread(quantised(candidates, id_column, vector_column, scale)), "vectors")
    pivots = choose_pivots(rows, n_pivots, pivot_sample)
    table = pivot_table(rows, pivots)
    asked = keep(quantised(queries, id_column, vector_column, scale).withColumn("row", F.monotonically_increasing_id()), "queries")
    blocks = -(-asked.count() // queries_in_block)
    found = spark.createDataFrame([], "row long, query_id long, vec_id long, score long")
    for b in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "id", "v").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        row, ids, v = (got.column(i).combine_chunks() for i in range(3))
        parts = [Block(row.to_numpy()[at], ids.to_numpy()[at], q, pivots, k) for at, q in _by_length(v)]
        held = spark.sparkContext.broadcast({p.q.shape[1]: p for p in parts})

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = {d: _fresh(p) for d, p in held.value.items()}
            for whole in batches:
                for lo in range(0, whole.num_rows, 4096):
                    batch = whole.slice(lo, 4096)
                    ids, bounded = batch.column(0).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
                    for at, c in _by_length(batch.column(1)):
                        if block := own.get(c.shape[1]):
                            yes = bounded[at]
                            if yes.any():
                                block.see(ids[at[yes]], c[yes], batch.column(2).take(pa.array(at[yes])).flatten().to_numpy().reshape(int(yes.sum()), -1))
                            if not yes.all():
                                block.see(ids[at[~yes]], c[~yes], None)
            for block in own.values():
                yield block.found()

        found = found.unionByName(keep(spread(table).mapInArrow(run, found.schema), "best"))
        held.destroy()
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _fresh(block: Block) -> Block:
    """A block of the same queries that has seen nothing; a worker may run several tasks over one broadcast."""
    out = Block.__new__(Block)
    out.__dict__ |= block.__dict__
    out.floor, out.best, out.scored = block.floor.copy(), list(block.best), 0
    return out
