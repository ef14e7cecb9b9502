"""Inverted index as DataFrames: positional postings, row lengths and corpus sums; boolean, phrase and prefix match; BM25."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stem import stem, stems
from corpusloom.functions.text import spaced, tokens
from corpusloom.plans.parser import And, Node, Not, Or, Phrase, phrases

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TOKENS_MOST = 1 << 20  # of the rows that share lists, unless one row has more
BYTES_MOST = 1 << 20  # of the rows that are split into words at once, unless one row has more
IN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


@dataclass
class Index:
    """postings: key, len, col, pos, term, where len is the row's over all indexed columns. lengths: key, len, a row for each indexed row.

    sums: rows and their total length where they are known already, as for a maintained index; else they are aggregated from lengths.
    """

    key: str
    postings: DataFrame
    lengths: DataFrame | None
    stemmed: bool = False
    buckets: int | None = None  # of saved postings
    sums: tuple[int, int] | None = None

    def save(self, path: str, buckets: int = 64) -> None:
        """Postings partitioned by a hash bucket of the term and sorted by term, so that a query reads the buckets of its words only and skips most row groups there."""
        self.postings.withColumn("bucket", bucket_of(buckets)).repartition(buckets, "bucket").sortWithinPartitions("term", self.key, "col", "pos").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @staticmethod
    def load(spark, path: str, key: str, stemmed: bool = False, buckets: int = 64) -> Index:
        return Index(key, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), stemmed, buckets)


def build(rows: DataFrame, key: str, columns: list[str], stemmed: bool = False) -> Index:
    """Index the columns of rows, which `key` identifies; all columns count for matches, frequencies and lengths. stemmed: words by their stems, in queries too."""
    own = tokenised(rows, [key], columns, stemmed)
    return Index(key, exploded(own, [key]), own.select(key, "len"), stemmed)


def tokenised(rows: DataFrame, keys: list[str], columns: list[str], stemmed: bool = False) -> DataFrame:
    """keys, cols (an array of the columns' tokens) and len, how many there are."""
    said = lambda c: tokens(F.col(c).cast("string"))
    own = rows.select(*keys, F.array(*(stems(said(c)) if stemmed else said(c) for c in columns)).alias("cols"))
    return own.withColumn("len", F.aggregate("cols", F.lit(0), lambda n, t: n + F.size(t)))


def exploded(tokenised: DataFrame, keys: list[str]) -> DataFrame:
    """Postings: keys, len, col, pos, term."""
    return tokenised.select(*keys, "len", F.posexplode("cols").alias("col", "t")).select(*keys, "len", "col", F.posexplode("t").alias("pos", "term"))


def texts(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and cols, an array of the columns' texts, spaced(): what listed() splits into the words of tokenised() by itself, a batch at a time."""
    return rows.select(*keys, F.array(*(spaced(F.col(c).cast("string")) for c in columns)).alias("cols"))


def listed(own: DataFrame, key: str, owner: str, stemmed: bool = False) -> DataFrame:
    """Postings by lists: term, keys, lens, cols, poss, a list for each term of a batch of rows, in order of its rows and places. own: of texts() or tokenised().

    A term of null lists each row once with its length and its owner (owners). A row's places of a term stand in one list. unlisted() gives the single postings.
    """
    split = "len" in own.columns
    own = own.select(F.col(key).alias("key"), F.col(owner).alias("owner"), "cols", *(["len"] if split else []))
    of = {c: own.schema[c].dataType.simpleString() for c in ("key", "owner")}
    return own.mapInArrow(_lists if split else partial(_lists_of_texts, stemmed=stemmed), f"term string, keys array<{of['key']}>, lens array<int>, cols array<tinyint>, poss array<int>, owners array<{of['owner']}>")


def _lists_of_texts(batches, stemmed: bool):
    held, n = [], 0
    for piece in _pieces(batches):
        own = _split(piece, stemmed)
        more = pc.sum(own.column("len")).as_py()
        if held and n + more > TOKENS_MOST:
            yield from _lists([pa.concat_batches(held)])
            held, n = [], 0
        held.append(own)
        n += more
    if held:
        yield from _lists([pa.concat_batches(held)])


def _pieces(batches):
    """Batches of at most BYTES_MOST of texts, or of one row."""
    for batch in batches:
        cols, begin = batch.column("cols"), 0
        sizes = np.cumsum(pc.binary_length(cols.flatten()).to_numpy(), dtype="int64")[np.cumsum(cols.value_lengths().to_numpy()) - 1]
        while begin < batch.num_rows:
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + BYTES_MOST, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _split(batch: pa.RecordBatch, stemmed: bool) -> pa.RecordBatch:
    """key, owner, len, cols of tokenised(): a word is a run of bytes of words within a text, found on the bytes of all texts at once."""
    cols = batch.column("cols")
    said = pa.concat_arrays([cols.flatten().cast(pa.string())])  # no offset
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(said).to_numpy())])
    data = np.frombuffer(said.buffers()[2] or b"", "uint8")[: ends[-1]]
    inside = IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(inside, dtype="int32")[starts] - 1, np.count_nonzero(inside)).astype("int32")
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    if stemmed:
        once = words.dictionary_encode()
        words = pa.array([stem(w) for w in once.dictionary.to_pylist()], pa.string()).take(once.indices)
    until, rows = np.searchsorted(starts, ends).astype("int32"), np.concatenate([[0], np.cumsum(cols.value_lengths().to_numpy())]).astype("int32")
    split = pa.ListArray.from_arrays(pa.array(rows), pa.ListArray.from_arrays(pa.array(until), words))
    return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("owner"), pa.array(np.diff(until[rows])), split], ["key", "owner", "len", "cols"])


def _lists(batches):
    for batch in batches:
        begin, sizes = 0, np.cumsum(batch.column("len").to_numpy())
        while begin < batch.num_rows:  # long rows: fewer in a list
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + TOKENS_MOST, side="right")))
            yield _list(batch.slice(begin, end - begin))
            begin = end


def _list(batch: pa.RecordBatch) -> pa.RecordBatch:
    key, length, cols = (batch.column(c) for c in ("key", "len", "cols"))
    texts = cols.flatten()
    words, n = texts.flatten().dictionary_encode(), texts.value_lengths().to_numpy()
    each = cols.value_lengths().to_numpy()
    row, col = np.repeat(np.arange(len(key)), each), np.arange(len(n)) - np.repeat(np.cumsum(each) - each, each)
    pos = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    codes = words.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    rows = np.concatenate([np.repeat(row, n)[order], np.arange(len(key))])
    ends = np.cumsum(np.bincount(codes, minlength=len(words.dictionary)))
    offsets = pa.array(np.concatenate([[0], ends, [len(rows)]]).astype("int32"))
    none = np.zeros(len(key))
    parts = [key.take(pa.array(rows)), length.take(pa.array(rows)), pa.array(np.concatenate([np.repeat(col, n)[order], none]).astype("int8")), pa.array(np.concatenate([pos[order], none]).astype("int32"))]
    terms = pa.concat_arrays([words.dictionary, pa.array([None], words.dictionary.type)])
    alone = pa.array([None] * len(ends) + [0, len(key)], "int32")  # no list but the last
    owners = pa.ListArray.from_arrays(alone, batch.column("owner").take(pa.array(np.arange(len(key)))))
    return pa.RecordBatch.from_arrays([terms, *(pa.ListArray.from_arrays(offsets, x) for x in parts), owners], ["term", "keys", "lens", "cols", "poss", "owners"])


def unlisted(lists: DataFrame, key: str) -> DataFrame:
    """Single postings of listed(): key, len, col, pos and the columns beside the lists."""
    own = ("keys", "lens", "cols", "poss")
    each = lists.select(*(c for c in lists.columns if c not in (*own, "owners")), F.inline(F.arrays_zip(*own)).alias(key, "len", "col", "pos"))
    return each.withColumn("col", F.col("col").cast("int"))


def _bucket(token: str, buckets: int) -> int:
    """The bucket that save() puts a term into: Spark's xxhash64 is XXH64 with seed 42, signed."""
    h = xxhash.xxh64_intdigest(token.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def _fits(token: str, prefix: bool) -> Column:
    return F.col("term").startswith(token) if prefix else F.col("term") == token


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def places(index: Index, wanted: list[Phrase]) -> DataFrame:
    """(key, len, col, k, start, n): where each phrase k begins, and its number of tokens.

    Each posting that fits a phrase's i-th token votes for the start pos - i; a start with all votes is an occurrence. So a phrase
    takes one aggregation and no self-join, and the filter on terms reaches the scan.
    """
    if index.stemmed:
        wanted = [replace(p, tokens=tuple(map(stem, p.tokens))) for p in wanted]
    votes = [F.when(_fits(t, p.prefix and i == len(p.tokens) - 1), F.struct(F.lit(k).alias("k"), (F.col("pos") - i).alias("start"))) for k, p in enumerate(wanted) for i, t in enumerate(p.tokens)]
    any_term = reduce(Column.__or__, [_fits(t, p.prefix and i == len(p.tokens) - 1) for p in wanted for i, t in enumerate(p.tokens)])
    need = F.element_at(F.array(*(F.lit(len(p.tokens)) for p in wanted)), F.col("v.k") + 1)
    postings = index.postings
    if index.buckets and not any(p.prefix for p in wanted):  # a prefix may stand in any bucket
        postings = postings.filter(F.col("bucket").isin(sorted({_bucket(t, index.buckets) for p in wanted for t in p.tokens})))
    cast = postings.filter(any_term).select(index.key, "len", "col", F.explode(F.filter(F.array(*votes), lambda v: v.isNotNull())).alias("v"))
    if all(len(p.tokens) == 1 for p in wanted):  # a vote is a start
        return cast.select(index.key, "len", "col", "v.k", "v.start", F.lit(1).cast("long").alias("n"))
    starts = cast.groupBy(index.key, "len", "col", F.col("v.k").alias("k"), F.col("v.start").alias("start"), need.alias("need")).agg(F.count("*").alias("n"))
    return starts.filter("n = need").drop("need")


def occurrences(index: Index, wanted: list[Phrase]) -> DataFrame:
    """(key, k, len, f): how often each phrase stands in each row, within one column."""
    return places(index, wanted).groupBy(index.key, "k").agg(F.first("len").alias("len"), F.count("*").alias("f"))


def _truth(node: Node, number: dict[Phrase, int]) -> Column:
    if isinstance(node, Phrase):
        return F.coalesce(F.col(f"f{number[node]}"), F.lit(0)) > 0
    left, right = _truth(node.left, number), _truth(node.right, number)
    return left & right if isinstance(node, And) else left | right if isinstance(node, Or) else left & ~right


def _gain(node: Node, number: dict[Phrase, int]) -> Column:
    """Sum of the phrases' parts; those below a node that the row doesn't satisfy don't count."""
    if isinstance(node, Phrase):
        return F.coalesce(F.col(f"p{number[node]}"), F.lit(0.0))
    return F.when(_truth(node, number), _gain(node.left, number) + _gain(node.right, number)).otherwise(F.lit(0.0))


def bm25(index: Index, query: Node) -> DataFrame:
    """(key, score) of the rows that match; lower scores are better.

    score = -sum over phrases of idf * f * (k1 + 1) / (f + k1 * (1 - b + b * len / mean len)), idf = ln((N - n + 0.5) / (n + 0.5)), 1e-6 at
    least; a phrase below a part of the query that the row doesn't satisfy adds nothing. n counts the rows that hold the phrase anywhere, so filters applied to the result never change scores.
    """
    wanted = list(dict.fromkeys(phrases(query)))
    number = {p: i for i, p in enumerate(wanted)}
    found = occurrences(index, wanted)
    held = found.groupBy("k").agg(F.count("*").alias("n"))
    if index.sums:
        held = held.withColumns({"rows": F.lit(index.sums[0]), "mean": F.lit(index.sums[1] / max(1, index.sums[0]))})
    else:
        corpus = index.lengths.agg(F.count("*").alias("rows"), (F.sum("len") / F.count("*")).alias("mean"), F.lit(0).alias("one"))
        held = held.withColumn("one", F.lit(0)).join(F.broadcast(corpus), "one")
    # one row for each phrase: a broadcast of at most the query's own size
    idf = held.select("k", "mean", F.greatest(F.log((F.col("rows") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF)).alias("idf"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = found.join(F.broadcast(idf), "k").withColumn("part", part)
    each = [F.max(F.when(F.col("k") == i, F.col(c))).alias(f"{n}{i}") for i in range(len(wanted)) for n, c in (("f", "f"), ("p", "part"))]
    return scored.groupBy(index.key).agg(*each).filter(_truth(query, number)).select(index.key, (-_gain(query, number)).alias("score"))


__all__ = ["And", "Index", "Not", "Or", "Phrase", "bm25", "build", "occurrences", "places"]
