"""Filter interaction audit: from counts of each part's failure masks to what every order of the filters keeps, by a subset-zeta transform.

A document's mask has a bit for each filter it fails. Per part the counts of masks are summed over all subsets of each mask (zeta transform), which
gives the survivors of every set of filters; a step of an order is the difference between two neighbouring sets. DataFrame functions only.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import hot_join, keep

LETTERS = "ABCDE"
SETS = 1 << len(LETTERS)
COUNTS = ("docs", "good", "toxic")
#: White space that ends a word.
SPACE = " \t\n\x0b\f\r"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3, of the filters A to D, for whole texts; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.split(bare, "[\\x20\\x09-\\x0D]+")
    n = F.when(bare == "", 0).otherwise(F.size(words)).cast("long")
    distinct = F.when(bare == "", 0).otherwise(F.size(F.array_distinct(words))).cast("long")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < 50, distinct * 100 < n * 65, capitals.cast("long") * 100 > F.length(text).cast("long") * 5, text.rlike("[#$%&*|]"))
    mask = F.lit(0)
    for bit, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): counts of documents by part and mask of failed filters.

    Only digests of texts are shuffled. E (a smaller id has the same text) is settled by one aggregate of digests joined back; rows that fail it move
    from their mask to the one with bit 4 as signed counts, so that no outer join is needed and a text that many rows share stays where it lies.
    A document counts as good or toxic if any of its label rows says so. Null ids never fail E and have no labels; ids may be repeated.
    """
    marks = labels.groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    marks = marks.filter("good + toxic > 0").withColumn("salt", F.lit(0).cast("long"))
    said = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2(said, 256)).alias("digest"))
    # null ids join nothing; the salt deals them over all tasks
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1 << 20))).otherwise(0))
    rows = rows.join(marks, ["doc_id", "salt"], "left").select("doc_id", "part", "mask", "digest", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")))
    rows = keep(rows, "filter-masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = hot_join(rows, firsts, "digest").filter("doc_id > first").groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    again = keep(again, "filter-copies")
    own = rows.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    signed = own.union(again.withColumn("n", -F.col("n"))).union(again.withColumn("mask", F.col("mask") + 16))
    return signed.groupBy("part", "mask").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def survivors(counted: DataFrame) -> DataFrame:
    """(part, own, docs, good, toxic): own[m] is the number of documents of mask m; the others, at index s, what the filters of set s leave."""
    held = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS)))).alias("by"))
    every = F.sequence(F.lit(0), F.lit(SETS - 1))

    def filled(c: str) -> Column:
        return F.transform(every, lambda m: F.coalesce(F.try_element_at("by", m)[c], F.lit(0).cast("long"))).alias(c)

    def summed(c: str, bit: int) -> Column:
        return F.transform(c, lambda x, i: x + F.when(i.bitwiseAND(1 << bit) != 0, F.get(F.col(c), i - (1 << bit))).otherwise(0)).alias(c)

    raw = held.select("part", *map(filled, COUNTS)).select("part", F.col("docs").alias("own"), *COUNTS)
    for bit in range(len(LETTERS)):  # the transform: a pass, and a projection, for each filter
        raw = raw.select("part", "own", *(summed(c, bit) for c in COUNTS))
    # a document that passes all filters of s has a mask within the complement of s
    return raw.select("part", "own", *(F.reverse(F.col(c)).alias(c) for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; see the columns below.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are not read, so their names can't clash. part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley. Null sources are the part of the empty string. An empty table has no part and no row.
    """
    orders = ["".join(p) for p in itertools.permutations(LETTERS)]
    weights = [math.factorial(k) * math.factorial(len(LETTERS) - 1 - k) for k in range(len(LETTERS))]
    found = survivors(masks(docs, labels))
    every = F.sequence(F.lit(0), F.lit(SETS - 1))

    def shapley(bit: int) -> Column:
        """Removals of a filter over all orders: each set before it stands in |set|! * (others)! of them."""
        gain = lambda s: F.get(F.col("docs"), s) - F.get(F.col("docs"), s + (1 << bit))
        weight = lambda s: F.get(F.array(*map(F.lit, weights)), F.bit_count(s))
        return F.aggregate(F.filter(every, lambda s: s.bitwiseAND(1 << bit) == 0), F.lit(0).cast("long"), lambda acc, s: acc + weight(s) * gain(s))

    found = found.withColumn("shapleys", F.array(*(shapley(b) for b in range(len(LETTERS)))))
    steps = found.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    letter = F.expr("substring(filter_order, step, 1)")
    before = F.lit(0)
    for bit, name in enumerate(LETTERS):
        before = before + F.when(F.instr("filter_order", name) < F.col("step"), 1 << bit).otherwise(0)
    steps = steps.withColumn("bit", F.instr(F.lit(LETTERS), letter) - 1).withColumn("before", before)
    steps = steps.withColumn("single", F.expr("shiftleft(1, bit)")).withColumn("after", F.col("before") + F.col("single"))
    lost = {c: F.get(F.col(c), F.col("before")) - F.get(F.col(c), F.col("after")) for c in COUNTS}
    failing = F.get(F.col("docs"), F.lit(0)) - F.get(F.col("docs"), F.col("single"))
    return steps.select(
        "part", "filter_order", "step", F.get(F.col("docs"), F.col("after")).alias("kept"), lost["docs"].alias("removed"), (failing - lost["docs"]).alias("redundant"),
        F.get(F.col("own"), F.col("single")).alias("unique_fails"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), F.get(F.col("shapleys"), F.col("bit")).alias("shapley"),
    )


#: The same rows by definition: every count is a sum over masks under the step's condition.
SQL = """
WITH d AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(ws) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INTEGER)
      + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS INTEGER)
      + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > first, false) AS INTEGER) AS mask
  FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
b AS (SELECT i AS bit, chr(CAST(65 + i AS INTEGER)) AS letter FROM range(5) r(i)),
o AS (SELECT b1.letter || b2.letter || b3.letter || b4.letter || b5.letter AS filter_order, [b1.bit, b2.bit, b3.bit, b4.bit, b5.bit] AS bits
  FROM b b1, b b2, b b3, b b4, b b5
  WHERE (1 << b1.bit) | (1 << b2.bit) | (1 << b3.bit) | (1 << b4.bit) | (1 << b5.bit) = 31),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, 1 << bits[k] AS one, list_sum(list_transform(bits[1:k], lambda x: 1 << x)) - (1 << bits[k]) AS before FROM o, range(1, 6) r(k)),
g AS (
  SELECT part, filter_order, step, one,
    sum(CASE WHEN mask & (before + one) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & one <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & one <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = one THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & one <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & one <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT part, mask, n, good, toxic, filter_order, step, one, CAST(before AS BIGINT) AS before FROM m, s) GROUP BY part, filter_order, step, one, before)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, one) AS BIGINT) AS shapley
FROM g
"""
