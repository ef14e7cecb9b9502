"""Licence scans in DataFrame functions only: a trained paragraph classifier, a calibrated unknown class, and a template comparison.

Every paragraph is classified by sparse word n-grams (1 to 3) and multinomial logistic regression; there is no filter before it. Below a threshold,
set on held-out texts that are no licence, the family is `unknown`. A family is confirmed if one of its templates is found in the
paragraph by enough n-grams. Training uses fixed texts, so its size is fixed.
"""

from __future__ import annotations

import functools
import json
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.license_texts import FRAMES, NAMES, NOTICES, OTHERS

UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *NOTICES]
#: What a family's template comparison looks for: its notices, names and identifiers.
TEMPLATES = {family: [*texts, *(x for part in NAMES.get(family, ()) for x in part)] for family, texts in NOTICES.items()}
#: A paragraph ends at a blank line or at a line's end behind the end of a sentence, so lines broken within a sentence stay together. Longer ones are
#: cut at white space before 600 characters.
BREAK, LONG, CUT = r"\n(?:(?<=[.!?\"')\]]\n)|(?=[ \t\r]*\n))", 600, r"(?s).{1,600}(?:\s|\z)|.{1,600}"


def _plain_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _plain_grams(text: str, sizes: Iterable[int] = (1, 2, 3)) -> list[str]:
    words = _plain_words(text)
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)))


@functools.cache
def _vocabulary() -> list[str]:
    return list(dict.fromkeys(g for texts in (*TEMPLATES.values(), FRAMES) for t in texts for g in _plain_grams(t)))


def _grammed(df: DataFrame) -> DataFrame:
    """Adds __words (runs of a-z and digits of `paragraph` in lower case, null for one that no feature has) and __grams (of the words, then runs of two and three), each worked out once."""
    words, two = F.col("__words"), F.col("__two")
    pairs = lambda a, skip: F.zip_with(a, F.slice(words, skip, F.size(words)), lambda x, y: F.concat(x, F.lit(" "), y))
    said = sorted({w for g in _vocabulary() for w in g.split()})
    own = df.withColumn("__words", F.transform(F.split(F.lower("paragraph"), "[^a-z0-9]+"), lambda w: F.when(w.isin(said), w))).withColumn("__two", pairs(words, 2))
    return own.withColumn("__grams", F.array_compact(F.concat(words, two, pairs(two, 3)))).drop("__two")


def training_rows(held: int | None = None, folds: int = 5) -> list[tuple[str, str, bool]]:
    """(text, family, held out): notices, names in carrier phrases, stretches of both within filler, and sentences that name no licence.

    A whole source (a notice, a carrier phrase, a sentence of the others) is held out in the fold `held`, with all that is made of it.
    """
    rng, rows = random.Random(42), []
    filler = "about the of a house with some people and green light for one day by many trees in river when stone from long time over small city to this is that it as was all you mit der die das und ein zu mit dem den von le la de et un que en sur el los una por con del mit".split()
    some = lambda a, b: [rng.choice(filler) for _ in range(rng.randint(a, b))]
    out = lambda i: held is not None and i % folds == held
    for family, texts in NOTICES.items():
        for i, text in enumerate(texts):
            words = text.split()
            rows += [(text, family, out(i))] * 3
            rows += [(" ".join([*some(0, 10), *words[at : at + 14], *some(0, 10)]), family, out(i)) for at in range(0, max(1, len(words) - 8), 5)]
            for k in range(16):
                n = len(words) if k < 4 or len(words) < 10 else rng.randint(8, len(words))
                at = rng.randint(0, len(words) - n)
                rows.append((" ".join([*some(0, 30), *words[at : at + n], *some(0, 30)]), family, out(i)))
    for family, (names, ids) in NAMES.items():
        for i, frame in enumerate(FRAMES):
            for name in names if "{}" in frame else ids:
                words = frame.replace("{}", name).replace("<>", name).split()
                rows.append((" ".join(words), family, out(i)))
                rows.append((" ".join([*some(0, 40), *words, *some(0, 40)]), family, out(i)))
    parts = sorted({w for texts in TEMPLATES.values() for t in texts for w in _plain_words(t)})
    for i, text in enumerate(OTHERS):
        rows += [(" ".join([*some(0, 30 * k), *text.split(), *some(0, 30 * k)]), UNKNOWN, out(i)) for k in range(8)]
    for i in range(1600):  # words of licences without their order, and filler alone
        words = some(4, 80)
        for _ in range(rng.randint(1, 6) if i % 4 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(parts))
        rows.append((" ".join(words), UNKNOWN, out(i)))
    return rows


@dataclass
class Model:
    vectorizer: CountVectorizerModel
    classifier: LogisticRegressionModel
    threshold: float


def _vectorizer() -> CountVectorizerModel:
    return CountVectorizerModel.from_vocabulary(_vocabulary(), inputCol="__grams", outputCol="__vector").setBinary(True)


def probable(df: DataFrame, vectorizer: CountVectorizerModel, classifier: LogisticRegressionModel) -> DataFrame:
    """Adds __best (index of the likeliest family other than unknown) and __p, its probability, to rows with `paragraph`."""
    p = vector_to_array("__probability")
    out = classifier.transform(vectorizer.transform(_grammed(df))).withColumn("__known", F.slice(p, 2, len(FAMILIES) - 1))
    return out.withColumn("__p", F.array_max("__known")).withColumn("__best", F.array_position("__known", F.col("__p")).cast("int"))


def _fitted(spark: SparkSession, vectorizer: CountVectorizerModel, rows: list[tuple[str, str, bool]]) -> LogisticRegressionModel:
    own = spark.createDataFrame([(s, float(FAMILIES.index(f))) for s, f, _ in rows], "paragraph string, label double").coalesce(1)
    data = vectorizer.transform(_grammed(own)).select("__vector", "label")
    return LogisticRegression(featuresCol="__vector", labelCol="label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction", family="multinomial", regParam=1e-3, maxIter=40).fit(data).setPredictionCol("")


def calibrated(spark: SparkSession, false_rate: float, held: int = 0) -> Model:
    """A model that saw none of the held-out sources; its threshold is the probability that false_rate of the held-out texts without a licence exceed."""
    rows, vectorizer = training_rows(held), _vectorizer()
    classifier = _fitted(spark, vectorizer, [r for r in rows if not r[2]])
    others = spark.createDataFrame([(t,) for t, f, out in rows if out and f == UNKNOWN], "paragraph string")
    return Model(vectorizer, classifier, float(probable(others, vectorizer, classifier).agg(F.percentile("__p", F.lit(1 - false_rate))).first()[0]))


@functools.lru_cache(maxsize=2)
def train(spark: SparkSession, false_rate: float = 0.005) -> Model:
    """Calibrate the threshold on held-out sources, then fit on all fixed rows; done once for each session."""
    vectorizer = _vectorizer()
    return Model(vectorizer, _fitted(spark, vectorizer, training_rows()), calibrated(spark, false_rate).threshold)


def _before(values: Column, block: int = 256) -> Column:
    """For each element of an array<bigint> the sum of those before it. Blocks are summed apart, so that no growing array is copied at every step."""
    none = F.array().cast("array<bigint>")
    sums = lambda x: F.aggregate(x, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.slice(values, i * block + 1, block))
    bases = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)))
    return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(sums(b), lambda v: v + base)))


def paragraphs(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows with start (code points) and paragraph instead of the text; white space at a paragraph's end is not part of it, blank ones are left out."""
    rest = [c for c in docs.columns if c != text_column]
    pieces = F.transform(F.split(F.col(text_column), BREAK), lambda p: F.concat(p, F.lit("\n")))
    found = docs.select(*rest, F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= LONG, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(CUT), F.lit(0))))).alias("__found"))
    sized = found.withColumn("__sizes", F.transform("__found", lambda p: F.length(p).cast("long"))).withColumn("__starts", _before(F.col("__sizes")))
    each = sized.select(*rest, F.explode(F.arrays_zip("__starts", "__found")).alias("__u")).select(*rest, F.col("__u.__starts").alias("start"), F.regexp_replace("__u.__found", r"\s+\z", "").alias("paragraph"))
    return each.filter("paragraph <> ''")


def scan(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", least_shared: float = 0.6) -> DataFrame:
    """A row for each paragraph: id, start, end (code points), family, probability, shared, confirmed.

    family is `unknown` below the model's threshold. shared: of the family's templates the largest part of n-grams (of three words, or of all
    words of a shorter one) that stand in the paragraph, or that the paragraph has in common with a longer one; confirmed: family known and shared
    at least least_shared. Null and empty texts have no rows; repeated rows have theirs each; an empty table gives none. Other columns are not read. Nothing is shuffled.
    """
    found = paragraphs(docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("text")))
    scored = probable(found, model.vectorizer, model.classifier)
    known = F.col("__p") >= model.threshold
    templates = [[_plain_grams(t, (min(3, len(_plain_words(t))),)) for t in TEMPLATES[f]] for f in FAMILIES[1:]]
    held = F.from_json(F.lit(json.dumps(templates)), "array<array<array<string>>>")
    threes = F.greatest(F.size(F.array_remove(F.split(F.lower("paragraph"), "[^a-z0-9]+"), "")) - 2, F.lit(1))
    shared = F.array_max(F.transform(F.element_at(held, F.col("__best")), lambda t: F.size(F.array_intersect(t, F.col("__grams"))) / F.least(F.size(t), threes)))
    out = scored.withColumn("__shared", F.when(known, F.least(shared, F.lit(1.0))).otherwise(0.0))
    family = F.when(known, F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("__best") + 1)).otherwise(UNKNOWN)
    return out.select(F.col("__id").alias(id_column), "start", (F.col("start") + F.length("paragraph")).alias("end"), family.alias("family"), F.col("__p").alias("probability"), F.col("__shared").alias("shared"), (known & (F.col("__shared") >= least_shared)).alias("confirmed"))
