"""Language ID by string kernels: blended-spectrum n-gram presence, Nystrom landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import slices, spread

UNKNOWN = "und"
#: Hash bits of the presence vectors of byte 1-, 2- and 3-grams; 1-grams are the bytes themselves.
BITS = (8, 12, 13)
EDGES = np.concatenate([[0], np.cumsum([1 << b for b in BITS])])
WIDTH = int(EDGES[-1])
_BLANK = np.array([0x20 if b < 0x80 and not chr(b).isalpha() else b for b in range(256)], np.uint8)
_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_LATIN.search(text) or any(map(str.isalpha, text)))


def presence(texts: list[str]) -> np.ndarray:
    """(len(texts), WIDTH) uint8: which n-grams of the lower-cased whole text occur; signs and digits count as blanks."""
    out = np.zeros((len(texts), WIDTH), np.uint8)
    data = [t.lower().encode() for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    if not sizes.sum():
        return out
    flat, codes = out.reshape(-1), _BLANK[np.frombuffer(b"".join(data), np.uint8)]
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * WIDTH, sizes)
    flat[row + codes] = 1
    gram = codes.astype(np.uint32)
    for k, bits in enumerate(BITS[1:], 1):
        gram = (gram[:-1] << np.uint32(8)) | codes[k:]
        inside = row[:-k] == row[k:]
        hashed = (gram * np.uint32(2654435761)) >> np.uint32(32 - bits)
        flat[(row[:-k] + (EDGES[k] + hashed))[inside]] = 1
    return out


def kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Mean over n of |common n-grams| / sqrt(|own| * |other|), by one matrix product for each n."""
    total = np.zeros((len(x), len(z)), np.float32)
    for lo, hi in zip(EDGES[:-1], EDGES[1:], strict=True):
        a, b = x[:, lo:hi].astype(np.float32), z[:, lo:hi].astype(np.float32)
        size = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None]
        total += (a @ b.T) / size
    return total / len(BITS)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits
    weights: np.ndarray  # (landmarks + 1, languages), the last row is the intercept

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.unpackbits(self.landmarks, axis=1, count=WIDTH)
        return kernel(presence(texts), z) @ self.weights[:-1] + self.weights[-1]


def fit(vectors: np.ndarray, labels: list[str], n_landmarks: int = 128, ridge: float = 1e-3) -> Model:
    """Nystrom features over landmarks taken in turn from each language, then ridge regression to +1 / -1 with balanced classes."""
    languages = sorted(set(labels))
    own = np.array(labels)
    turns = [np.flatnonzero(own == lang) for lang in languages]
    order = [rows[i] for i in range(max(map(len, turns), default=0)) for rows in turns if i < len(rows)]
    z = vectors[order[:n_landmarks]]
    values, basis = np.linalg.eigh(kernel(z, z).astype(np.float64))
    held = values > 1e-6 * values.max()
    to_features = basis[:, held] / np.sqrt(values[held])
    phi = kernel(vectors, z).astype(np.float64) @ to_features
    phi = np.hstack([phi, np.ones((len(phi), 1))])
    y = np.where(own[:, None] == np.array(languages)[None], 1.0, -1.0)
    w = np.array([1 / len(turns[languages.index(lang)]) for lang in labels])[:, None]
    w *= len(labels) / w.sum()
    penalty = np.eye(phi.shape[1]) * ridge * len(labels)
    penalty[-1, -1] = 0
    beta = np.linalg.solve(phi.T @ (w * phi) + penalty, phi.T @ (w * y))
    return Model(languages, np.packbits(z, axis=1), np.vstack([to_features @ beta[:-1], beta[-1:]]).astype(np.float32))


def held_out(id_column: str) -> Column:
    """The remainder of crc32 of the id as text by 4 is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = 400, n_landmarks: int = 128) -> Model | None:
    """Fit on at most per_language labelled documents of each language outside the held-out quarter, those of smallest id hash; one row for each id.

    Of a language that stands in many rows only ids of small hash, eight times as many as needed, are read; so no language is gathered, nor are all ids
    shuffled. Rows that repeat an id count once, by their smallest presence vector. Presence vectors (about 1.6 KB each) go to the driver, never
    texts: per_language for each language at most. None if there is no such document.
    """
    usable = docs.filter(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    usable = usable.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"), F.xxhash64(id_column).alias("h"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    many = counts.filter(F.col("n") > counts.agg(F.greatest(F.lit(8 * per_language), F.expr("sum(n) div 10000"))).scalar())  # 10,000 languages at most
    drawn = usable.join(F.broadcast(many), "lang", "left").filter(F.col("n").isNull() | (F.pmod(F.col("h"), F.lit(1 << 30)) * F.col("n") < 8 * per_language * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(presence([t])[0]).tobytes() if has_letter(t) else None for t in texts], pa.binary()), batch.column(1), batch.column(2)], names=["bits", "lang", "h"])

    one = drawn.select("text", "lang", "h").mapInArrow(run, "bits binary, lang string, h long").filter("bits is not null").groupBy("lang", "h").agg(F.min("bits").alias("bits"))
    for keys in (("lang", "part"), ("lang",)):  # first within 64 parts of a language, then their firsts
        one = one.withColumn("part", F.pmod("h", F.lit(64))).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("n") <= per_language).select("lang", "h", "bits")
    got = one.collect()
    got.sort(key=lambda r: (r["lang"], r["h"]))
    if not got:
        return None
    vectors = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in got), np.uint8).reshape(len(got), -1), axis=1, count=WIDTH)
    return fit(vectors, [r["lang"] for r in got], n_landmarks)


def _named(texts: list[str | None], model: Model | None, rows_at_once: int) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    said = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    for k in range(0, len(said), rows_at_once):
        own = said[k : k + rows_at_once]
        got = model.scores([texts[i] for i in own])
        best = got.argmax(1)
        for i, b, s in zip(own, best.tolist(), got[np.arange(len(own)), best].tolist(), strict=True):
            names[i], scores[i] = model.languages[b], min(1.0, max(0.0, (s + 1) / 2))
    return names, scores


def predict(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text", rows_at_once: int = 256) -> DataFrame:
    """(id, lang_pred, score from 0 to 1) for each document's whole text.

    `und` with score 0 where the text is null or has no letter, or where no model could be fitted. Repeated rows stay;
    an empty table gives no rows. Only the text is an input of the prediction; other columns are not read.
    """
    schema = T.StructType([docs.schema[id_column], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            names, scores = _named(batch.column(1).to_pylist(), model, rows_at_once)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return spread(docs.select(id_column, text_column)).mapInArrow(run, schema)


def known(docs: DataFrame, model: Model | None, text_column: str = "text", rows_at_once: int = 256) -> DataFrame:
    """The rows, as they are, that predict() names a language for; without a model those whose text has a letter."""
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            texts = batch.column(place).to_pylist()
            yield batch.filter(pa.array([n != UNKNOWN for n in _named(texts, model, rows_at_once)[0]] if model else [has_letter(t) for t in texts], pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)
