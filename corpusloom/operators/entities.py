"""Entities of documents: names of a gazetteer found in overlapping chunks, the longest where they overlap, acronyms rewritten, labels weighed and voted.

The names are a token trie in two tables, dealt by first token: which lengths begin with a token, and the names themselves. A document's positions meet the
first by their token and the second by the tokens that follow, so no machine holds the whole gazetteer and no position is tried against all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import normalize_term, tokens
from corpusloom.operators import documents, resolve
from corpusloom.sources.shared import fresh_path

CHUNK, OVERLAP, LONGEST = 350, 20, 8


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def gazetteer(names: DataFrame) -> DataFrame:
    """phrase, n, label, score of names (name, label, score) as tokens; names without a token or with more than LONGEST are left out."""
    own = names.withColumn("words", tokens(F.col("name"))).filter(F.size("words").between(1, LONGEST))
    return own.groupBy(_joined(F.col("words")).alias("phrase"), F.size("words").alias("n"), "label").agg(F.max("score").alias("score"))


def matches(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """key, start (token), n, phrase of all places where a name stands in a document, each once although chunks overlap.

    Chunks of CHUNK tokens overlap by OVERLAP, which is longer than any name, so none is cut. Null texts have none.
    """
    step = CHUNK - OVERLAP
    words = docs.select(key, tokens(F.col(text)).alias("all"))
    chunks = words.select(key, "all", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - OVERLAP - 1, F.lit(0)), F.lit(step))).alias("from")).select(key, "from", F.slice("all", F.col("from") + 1, CHUNK).alias("words"))
    at = F.posexplode(F.transform("words", lambda _, i: F.slice("words", i + 1, LONGEST)))
    places = chunks.select(key, "from", at.alias("pos", "ahead")).select(key, (F.col("from") + F.col("pos")).alias("start"), "ahead").withColumn("first", F.get("ahead", 0))
    phrases = gazetteer(names).select("phrase", "n").distinct()
    begins = phrases.groupBy(F.substring_index("phrase", " ", 1).alias("first")).agg(F.collect_set("n").alias("lengths"))  # LONGEST lengths at most
    tried = places.join(begins, "first").select(key, "start", "ahead", F.explode(F.filter("lengths", lambda n: n <= F.size("ahead"))).alias("n"))
    found = tried.select(key, "start", "n", _joined(F.slice("ahead", 1, F.col("n"))).alias("phrase"))
    return found.join(phrases.select("phrase"), "phrase", "left_semi").select(key, "start", "n", "phrase").distinct()


def longest(found: DataFrame, key: str) -> DataFrame:
    """Matches that no longer one overlaps, nor an earlier one of equal length."""
    near = Window.partitionBy(key).orderBy("start").rangeBetween(-LONGEST + 1, LONGEST - 1)
    other = F.collect_list(F.struct("start", "n")).over(near)
    beaten = F.exists("others", lambda o: (o["start"] < F.col("start") + F.col("n")) & (F.col("start") < o["start"] + o["n"]) & ((o["n"] > F.col("n")) | ((o["n"] == F.col("n")) & (o["start"] < F.col("start")))))
    return found.withColumn("others", other).filter(~beaten).drop("others")


def written(rows: DataFrame) -> DataFrame:
    """The rows written to the shared folder: counts and votes both read them, and the documents are matched once."""
    path = fresh_path(rows.sparkSession, "spans")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def extract(docs: DataFrame, key: str, text: str, names: DataFrame, thresholds: dict[str, float] | None = None, labels: list[str] | None = None) -> DataFrame:
    """key, norm, label, n: entities of each document with the label that the corpus votes for and how often they stand there.

    names: name, label, score; a name may have several labels. Places take the label of the highest score; those under its threshold are dropped, as are names
    that are none (is_garbage). A name that the document defines as an acronym counts as its long form.
    """
    spans = longest(matches(docs, key, text, names), key).join(gazetteer(names).drop("n"), "phrase")
    spans = spans.withColumn("ord", F.row_number().over(Window.partitionBy(key, "start").orderBy("label")))
    best = resolve.over_threshold(resolve.best_label(spans.withColumn("norm", F.col("phrase")), [key, "start"]), thresholds or {})
    best = best.filter(~documents.is_garbage(F.col("norm"), labels or []))
    defined = docs.filter(F.col(text).rlike(r"\([^()]{2,40}\)")).select(key, F.explode(documents.acronyms(F.col(text))).alias("p")).select(key, _joined(tokens(F.col("p.short"))).alias("norm"), _joined(tokens(F.col("p.long"))).alias("long")).dropDuplicates([key, "norm"])
    own = best.join(defined, [key, "norm"], "left").withColumn("norm", normalize_term(F.coalesce("long", "norm")))
    own = written(own.select(key, "norm", "label", "score", F.xxhash64(key, "start").alias("ord")))
    voted = resolve.vote(own.select("norm", "label", "score", "ord"))
    return own.groupBy(key, "norm").agg(F.count("*").alias("n")).join(voted.select("norm", "label"), "norm").select(key, "norm", "label", "n")
