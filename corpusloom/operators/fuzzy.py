"""Names alike by the Indel ratio, 200 * common subsequence / (length + length), without comparing all pairs.

similar_pairs() joins two tables of names from a ratio of 80 on: a pair shares so many bigrams that it meets on one of the rarest few of each name; pairs too
short for that differ by one letter at most and meet on a deletion. similar_to() asks a stated set of topics of all names at any ratio: where a topic's
likest names are within a letter, they meet on deletions; the others are compared a topic and many names at a time. Both are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources import shared

#: Topics and names that a task compares: blocks are dealt by hash, so each holds about this many.
BLOCK, NAMES = 4096, 32768


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * common / (len a + len b); two empty strings are alike."""
    total = len(a) + len(b)
    return 100.0 * 2 * _common(a, b) / total if total else 100.0


def ratio_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else ratio(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """False where the lengths alone keep the ratio below `least`."""
    return 200.0 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


def numbered(parts: Column) -> Column:
    """An array's items with a number for each repetition, so that sets of them are multisets."""
    return F.transform(parts, lambda x, i: F.concat(x, F.size(F.filter(F.slice(parts, 1, i), lambda y: y == x)).cast("string")))


def bigrams(name: Column) -> Column:
    return numbered(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(2))))


def _bigrams_needed(a: Column, b: Column, least: float) -> Column:
    """Of a common subsequence of c letters, c - 1 neighbours; each letter besides it parts one pair of them at most: 3c - 1 - len a - len b are bigrams of both."""
    return F.ceil((F.length(a) + F.length(b)) * (3 * least / 200 - 1) - 1 - 1e-9)


def _keys(names: DataFrame, least: float, rarity: DataFrame | None, scope: list[str]) -> DataFrame:
    """scope, name, key: the rarest bigrams of each name, one more than it can lack in any pair; for short names also themselves with one letter less."""
    size = F.length("name")
    shortest = F.ceil(size * least / (200 - least) - 1e-9)
    need = F.greatest(F.lit(1), F.ceil((size + shortest) * (3 * least / 200 - 1) - 1 - 1e-9))
    grams = names.filter(size > 1).select(*scope, "name", (size - need).alias("most"), F.explode(bigrams(F.col("name"))).alias("gram"))
    ranked = grams.join(rarity, "gram", "left").withColumn("place", F.row_number().over(Window.partitionBy(*scope, "name").orderBy("n", "gram")))
    own = ranked.filter("place <= most").select(*scope, "name", F.concat(F.lit("g"), "gram").alias("key"))
    # two names whose lengths sum to less than 2 / (3 * least / 200 - 1) may share no bigram
    short = math.ceil(2 / (3 * least / 200 - 1)) - 1
    cuts = F.transform(F.sequence(F.lit(0), size), lambda i: F.when(i == 0, F.col("name")).otherwise(F.concat(F.substr("name", F.lit(1), i - 1), F.substr("name", i + 1))))
    less = names.filter(size < short).select(*scope, "name", F.explode(F.array_distinct(cuts)).alias("cut")).select(*scope, "name", F.concat(F.lit("d"), "cut").alias("key"))
    return own.unionByName(less)


def candidates(a: DataFrame, b: DataFrame, least: float, scope: list[str]) -> DataFrame:
    """scope, x, y: pairs of distinct names of a and b (scope, name) that share a key and enough bigrams; all that reach the ratio, and few others."""
    if not 80 <= least <= 100:
        raise ValueError("a ratio of 80 to 100; below, ask with similar_to()")
    a, b = (df.select(*scope, "name").filter("name is not null").distinct() for df in (a, b))
    rarity = a.select("name").unionByName(b.select("name")).filter(F.length("name") > 1).select(F.explode(bigrams(F.col("name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    left = _keys(a, least, rarity, scope).withColumnRenamed("name", "x")
    right = _keys(b, least, rarity, scope).withColumnRenamed("name", "y")
    x, y = F.col("x"), F.col("y")
    met = left.join(right, [*scope, "key"]).filter(may_reach(x, y, least)).select(*scope, "x", "y").distinct()
    shared = F.size(F.array_intersect(bigrams(x), bigrams(y)))
    return met.filter((_bigrams_needed(x, y, least) < 1) | (shared >= _bigrams_needed(x, y, least)))


def similar_pairs(a: DataFrame, b: DataFrame, least: float, scope: list[str]) -> DataFrame:
    """scope, x, y, ratio of all pairs of names of a and b in one scope that reach the ratio. Names are compared as they are, each distinct one once; null names are alike to nothing."""
    found = candidates(a, b, least, scope).withColumn("ratio", ratio_column(F.col("x"), F.col("y")))
    return found.filter(F.col("ratio") >= least)


def _likest(said: list[str], buckets: np.ndarray, lows: list[str], least: float, most: int) -> tuple[list, list, list]:
    """Topic places, name places and similarities: for each topic and bucket the `most` names likest to it. Names stand by bucket, then name.

    The common subsequences of one topic with all names of a length are found together, a bit for each letter of the topic; a topic of over 63 letters is compared one by one.
    """
    sizes = np.array([len(n) for n in lows], np.int64)
    alphabet = {c: i for i, c in enumerate(sorted(set().union(*lows)))}
    classes = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        classes[size] = at, np.array([[alphabet[c] for c in lows[i]] for i in at.tolist()], np.int32).T.copy()
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
    out: tuple[list, list, list] = ([], [], [])
    for t, a in enumerate(said):
        m, alike = len(a), np.full(len(lows), -1, np.int64)
        bits = np.zeros(len(alphabet), np.uint64)
        for i, c in enumerate(a if m < 64 else ""):
            if c in alphabet:
                bits[alphabet[c]] |= np.uint64(1 << i)
        full = np.uint64((1 << m) - 1 if m < 64 else 0)
        for size, (at, letters) in classes.items():
            if 200.0 * min(m, size) < least * (m + size) - 1e-6:
                continue
            if m < 64:
                row = np.full(len(at), full, np.uint64)
                for column in letters:
                    u = row & bits[column]
                    row = (row + u) | (row - u)
                common = m - np.bitwise_count(row & full).astype(np.int64)
            else:
                common = np.array([_common(a, lows[i]) for i in at.tolist()], np.int64)
            alike[at] = np.floor(200.0 * common / (m + size) + 1e-9).astype(np.int64)
        for lo, hi in zip(edges, edges[1:], strict=False):
            good = lo + np.flatnonzero(alike[lo:hi] >= least)
            if len(good) > most:
                key = alike[good] * len(lows) + (len(lows) - good)
                good = good[np.argpartition(key, -most)[-most:]]
            out[0].extend([t] * len(good))
            out[1].extend(good.tolist())
            out[2].extend(alike[good].tolist())
    return out


def _cuts(name: str) -> Column:
    """A name itself and all that it becomes without one letter."""
    size = F.length(name)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), size), lambda i: F.when(i == 0, F.col(name)).otherwise(F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))))


def _similarity(total: Column, apart: Column) -> Column:
    """The ratio without its fraction of two names whose lengths sum to `total` and of which `apart` letters are in no common subsequence."""
    return F.floor(100.0 * (total - apart) / total + 1e-9).cast("int")


def _near(asked: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """topic, code, bucket, name, similarity: the `most` likest names of a topic in a bucket, where pairs that meet on a deletion settle them.

    These are all pairs of lengths at most one apart with one or two letters besides the common ones. What the lengths in the bucket allow any other pair is
    a bound; a topic is settled there if `most` names are above it.
    """
    m, n = F.length("said"), F.length("low")
    left = asked.select("topic", "said", F.explode(_cuts("said")).alias("key"))
    right = names.select("code", "bucket", "name", "low", F.explode(_cuts("low")).alias("key"))
    met = left.join(right, "key").select("topic", "said", "code", "bucket", "name", "low").distinct()
    met = met.withColumn("similarity", _similarity(m + n, F.when(F.col("said") == F.col("low"), 0).when(m != n, 1).otherwise(2)))
    size = F.col("m")
    rest = lambda x: F.when(x == size, 4).when(F.abs(x - size) == 1, 3).otherwise(F.abs(x - size))
    lengths = names.groupBy("code").agg(F.collect_set(n).alias("lengths"))
    bounds = asked.select(m.alias("m")).distinct().crossJoin(lengths).withColumn("bound", F.array_max(F.transform("lengths", lambda x: _similarity(x + size, rest(x))))).drop("lengths")
    over = met.withColumn("m", m).join(bounds, ["m", "code"]).filter(F.col("similarity") > F.col("bound"))
    w = Window.partitionBy("topic", "code")
    over = over.withColumn("place", F.row_number().over(w.orderBy(F.desc("similarity"), "name"))).filter(F.col("place") <= most)
    return over.withColumn("n", F.count("*").over(w)).filter(F.col("n") == most).select("topic", "code", "bucket", "name", "similarity")


def similar_to(topics: DataFrame, names: DataFrame, least: int = 70, most: int = 5) -> DataFrame:
    """topic, bucket, place, name, id, similarity: of each bucket the `most` names likest to a topic in lower case; ties by name, then id.

    topics: topic; a stated set. In buckets of more than NAMES names _near() settles what it can. Topics that are left are asked of a bucket's names in blocks of about BLOCK,
    which meet blocks of about NAMES names; each pair of blocks hands on `most` names for each topic. similarity is the ratio without its fraction, `least` or more. Names are
    compared once for each bucket however often they occur, and of equal ones in a bucket the first ids stand for all. Null and empty topics and names are alike to nothing.
    """
    code = F.coalesce(F.concat(F.lit("b"), F.col("bucket").cast("string")), F.lit("")).alias("code")
    asked = topics.select("topic", F.lower("topic").alias("said")).filter("said <> ''").distinct()
    distinct = names.select(code, "bucket", "name", F.lower("name").alias("low")).filter("low <> ''").distinct()
    held_by = distinct.groupBy("code").agg(F.ceil(F.count("*") / NAMES).cast("int").alias("m"))
    large = [r["code"] for r in held_by.filter("m > 1").select("code").collect()]
    pairs, settled = asked.crossJoin(held_by), None
    if large:
        path = shared.fresh_path(names.sparkSession, "near")
        near = _near(asked, distinct.filter(F.col("code").isin(large)), most)
        near.write.parquet(path)
        settled = names.sparkSession.read.schema(near.schema).parquet(path)
        pairs = pairs.join(settled.select("topic", "code").distinct(), ["topic", "code"], "left_anti")
    parts = held_by.join(pairs.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")), "code")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    dealt = lambda key, k: F.pmod(F.xxhash64(key), F.col(k)).cast("int")
    left = pairs.drop("m").join(parts, "code").select(F.col("code").alias("asked"), "topic", "said", dealt("topic", "n").alias("a"), every("m").alias("b"))
    right = distinct.join(parts, "code").select("code", "bucket", "name", "low", dealt("name", "m").alias("b"), every("n").alias("a"))
    kinds = T.StructType([topics.schema["topic"], names.schema["bucket"], names.schema["name"], T.StructField("similarity", T.IntegerType())])

    def run(block: pa.Table, held: pa.Table) -> pa.Table:
        if not (block.num_rows and held.num_rows):
            return pa.table({f.name: pa.array([], t) for f, t in zip(kinds, (block["topic"].type, held["bucket"].type, held["name"].type, pa.int32()), strict=True)})
        held = held.sort_by([("bucket", "ascending"), ("name", "ascending")])
        codes = pc.dictionary_encode(held["bucket"], null_encoding="encode").combine_chunks().indices.to_numpy(zero_copy_only=False)
        i, j, alike = _likest(block["said"].to_pylist(), codes, held["low"].to_pylist(), least, most)
        i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
        return pa.table({"topic": block["topic"].take(i), "bucket": held["bucket"].take(j), "name": held["name"].take(j), "similarity": pa.array(alike, pa.int32())})

    found = left.groupBy("asked", "a", "b").cogroup(right.groupBy("code", "a", "b")).applyInArrow(run, kinds)
    if settled is not None:
        found = found.unionByName(settled.drop("code").filter(F.col("similarity") >= least))
    first = Window.partitionBy("bucket", "name").orderBy("id")
    held = names.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).select(F.col("bucket").alias("held_bucket"), F.col("name").alias("held_name"), "id")
    likest = Window.partitionBy("topic", "bucket").orderBy(F.desc("similarity"), "name", "id")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("topic", "bucket").orderBy(F.desc("similarity"), "name"))).filter(F.col("place") <= most).drop("place")
    ranked = best.join(held, (F.col("name") == F.col("held_name")) & F.col("bucket").eqNullSafe(F.col("held_bucket"))).withColumn("place", F.row_number().over(likest)).filter(F.col("place") <= most)
    return ranked.select("topic", "bucket", "place", "name", "id", "similarity")
