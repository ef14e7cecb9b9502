"""Benchmark decontamination by spaced seeds: masks that ignore some word positions, joined hashes, and verified overlaps around hits."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm import chars
from corpusloom.llm.common import gather, keep, slices, spread

#: Seeds of five words; a 1 is a word that must agree. Each stretch that counts as an overlap (see needed) holds one of them, whichever words are replaced: the tests try all patterns.
MASKS = ("11111", "111011", "1101011", "11100101")
#: Seeds of benchmark texts too short for these, whole texts.
SHORT = ("1", "11", "111", "1111")
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BITS = 20
SLICE = 1 << 20  # bytes of texts that are compared at once; arrays over them take about 50 times as much


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _power(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(16, (n - 1).bit_length()))[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """The words of some texts: runs of letters and numbers, lower-cased. start and end are code points within their text."""

    points: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    base: np.ndarray

    def said(self, i: int) -> bytes:
        at = self.base[self.text[i]]
        return self.points[at + self.start[i] : at + self.end[i]].tobytes()


def words(texts: list[str | None]) -> Words:
    texts = [(t or "") + "\n" for t in texts]
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    raw = chars.points("".join(texts))
    points = chars.lower()[raw]
    kind = chars.classes()[points]
    inside = (kind == chars.LETTER) | (kind == chars.NUMBER)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    lo, hi = edge[::2], edge[1::2]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(points)))]) if len(points) else np.zeros(1, np.uint64)
    hashes = _mixed((upto[hi] - upto[lo]) * _power(_INVERSE, len(points) + 1)[lo])
    text = np.searchsorted(base, lo, side="right") - 1
    return Words(points, hashes, text, lo - base[text], hi - base[text], base)


def _seeds(w: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the mask at every place where it lies within one text."""
    n = len(w.hashes) - len(mask) + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for i, c in enumerate(mask):
        if c == "1":
            factor = factor * _BASE % (1 << 64)
            total += w.hashes[i : i + n] * np.uint64(factor)
    inside = np.flatnonzero(w.text[:n] == w.text[len(mask) - 1 :])
    return inside, _mixed(total[inside])


def needed(n: int) -> int:
    """Words that must agree for an overlap with a benchmark text of n words to count: all of one under ten words, else four fifths, 13 at most."""
    return n if n < 10 else min(13, -(-4 * n // 5))


@dataclass
class Index:
    """Seeds of a bounded block of benchmark texts: the side of the hash join that is broadcast."""

    ids: list
    items: Words
    first: np.ndarray  # first word of each text
    size: np.ndarray  # words of each text
    tables: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]  # mask, sorted hashes, their first words, bitmap of high bits

    @staticmethod
    def of(ids: list, texts: list[str | None]) -> Index:
        w = words(texts)
        size = np.bincount(w.text, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size
        tables = []
        for mask in (*MASKS, *SHORT):
            place, h = _seeds(w, mask)
            if mask in SHORT:
                whole = size[w.text[place]] == len(mask)
                place, h = place[whole], h[whole]
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[h >> np.uint64(64 - _BITS)] = True
            tables.append((mask, h[order], place[order], bitmap))
        return Index(ids, w, first, size, tables)

    def _diagonals(self, w: Words, most: int = 1 << 20) -> np.ndarray:
        """Rows (text, item, shift), each once: the places of items over texts that a seed hits. Hits are joined in portions of about `most`."""
        n, m = len(w.hashes), len(self.items.hashes)
        items, span = len(self.ids), n + m + 1
        keys = [np.zeros(0, np.int64)]
        for mask, known, places, bitmap in self.tables:
            if not len(known):
                continue
            at, h = _seeds(w, mask)
            may = bitmap[h >> np.uint64(64 - _BITS)]
            at, h = at[may], h[may]
            lo, hi = np.searchsorted(known, h, side="left"), np.searchsorted(known, h, side="right")
            upto = np.cumsum(hi - lo)
            total = int(upto[-1]) if len(upto) else 0
            cuts = [*np.searchsorted(upto, np.arange(0, total, most)).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own, here = places[gather(lo[a:b], (hi - lo)[a:b])], np.repeat(at[a:b], (hi - lo)[a:b])
                keys.append(np.unique((w.text[here] * items + self.items.text[own]) * span + (here - own + m)))
                if len(keys) > 16:
                    keys = [np.unique(np.concatenate(keys))]
        key = np.unique(np.concatenate(keys))
        return np.stack([key // span // items, key // span % items, key % span - m], 1)

    def _stretch(self, w: Words, bounds: np.ndarray, text: int, item: int, shift: int, best: tuple | None, exact: bool) -> tuple | None:
        """(-matched, start, end, words, first word of the item, first word of the text) along a diagonal, or None if it is no overlap or surely no better than `best`."""
        lo = max(int(self.first[item]), int(bounds[text]) - shift)
        hi = min(int(self.first[item] + self.size[item]), int(bounds[text + 1]) - shift)
        least = max(needed(int(self.size[item])), -best[0] if best else 0)
        if hi - lo < least:
            return None
        same = self.items.hashes[lo:hi] == w.hashes[lo + shift : hi + shift]
        if np.count_nonzero(same) < least:
            return None
        if exact:
            same = np.array([bool(s) and self.items.said(lo + i) == w.said(lo + shift + i) for i, s in enumerate(same.tolist())])
        sums, agreed = (np.concatenate([[0], np.cumsum(x)]) for x in (np.where(same, 1, -4), same))
        begins = np.searchsorted(-np.minimum.accumulate(sums), -sums, side="left")  # for each end the first begin with no higher sum
        end = int(np.argmax(agreed - agreed[begins]))
        begin, matched = int(begins[end]), int(agreed[end] - agreed[begins[end]])
        if matched < least:
            return None
        begin += int(np.argmax(same[begin:]))
        return -matched, int(w.start[lo + shift + begin]), int(w.end[lo + shift + end - 1]), end - begin, lo + begin, lo + shift + begin

    def overlaps(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, start, end, words, matched): for each text and item the overlap of most matched words; code points of the text.

        A hit of a seed fixes the item's place over the text. Along it the overlap is the stretch of most agreeing words of which
        at least four fifths agree (+1 for one that does and -4 for one that doesn't sum to 0 or more). Words are compared by
        64-bit hashes, and those of the best overlap as written, lower-cased; if any differs, all places of the pair are compared as written.
        """
        w = words(texts)
        bounds = np.searchsorted(w.text, np.arange(len(texts) + 1))
        diagonals = self._diagonals(w)
        pairs = np.flatnonzero(np.any(np.diff(diagonals[:, :2], axis=0, prepend=-1), axis=1)).tolist()
        out = []
        for lo, hi in zip(pairs, [*pairs[1:], len(diagonals)], strict=False):
            text, item = diagonals[lo, :2].tolist()
            for exact in (False, True):
                best = None
                for shift in diagonals[lo:hi, 2].tolist():
                    found = self._stretch(w, bounds, text, item, shift, best, exact)
                    best = min(best, found) if best and found else best or found
                if not best or exact:
                    break
                same = [i for i in range(best[3]) if self.items.hashes[best[4] + i] == w.hashes[best[5] + i]]
                if all(self.items.said(best[4] + i) == w.said(best[5] + i) for i in same):
                    break
            if best:
                out.append((text, item, *best[1:4], -best[0]))
        return out


def compared(batches: Iterator[pa.RecordBatch], index: Index, text_column: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, int, int, int]]]]:
    """Slices of the batches and their texts' overlaps."""
    for batch in slices(batches, text_column, SLICE):
        yield batch, index.overlaps(batch.column(batch.schema.get_field_index(text_column)).to_pylist())


def indexes(benchmark: DataFrame, id_column: str, text_column: str, most_chars: int = 4 << 20) -> Iterator[tuple[Index, bool]]:
    """The benchmark in blocks of about most_chars characters, and whether the block is the last; each is collected and indexed when it is asked for."""
    rows = benchmark.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).filter("t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // most_chars)
    for b in range(blocks):
        own = sorted(rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).distinct().collect(), key=lambda r: (r["i"] is None, r["i"] if r["i"] is not None else 0, r["t"]))
        yield Index.of([r["i"] for r in own], [r["t"] for r in own]), b == blocks - 1


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, start, end, words, matched): documents that hold a benchmark text or 13 words of it with at most a fifth replaced.

    One row for each document row and item, the overlap of most matched words; start and end are code points of the document's text.
    Documents' seeds are hash-joined with the benchmark's, which is broadcast: one block of bounded size at a time, its rows written before the
    next is collected. Documents are read once for each block and never shuffled.

    Null texts hold nothing. Items of fewer than ten words must stand there whole and unchanged. Repeated documents each have their rows; repeated items
    count once; ids may be null. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    fields = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("item_id", benchmark.schema[item_column].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "end", "words", "matched"))])
    out, item_type = spark.createDataFrame([], fields), to_arrow_type(benchmark.schema[item_column].dataType)
    for index, last in indexes(benchmark, item_column, item_text):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch, found in compared(batches, held.value, text_column):
                if found:
                    text, item, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array([held.value.ids[i] for i in item], item_type), *(pa.array(c, pa.int64()) for c in rest)], names=fields.names)

        own = spread(docs.select(id_column, text_column)).mapInArrow(run, fields)
        if not last:
            own = keep(own, "overlaps")
            held.destroy()
        out = out.unionByName(own)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without an overlap, all columns as they are, by the rule of find_overlaps(); written anew for each block of the benchmark but the last."""
    for index, last in indexes(benchmark, item_column, item_text):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch, found in compared(batches, held.value, text_column):
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, *_ in found]] = False
                yield batch.filter(pa.array(clean))

        docs = spread(docs).mapInArrow(run, docs.schema)
        if not last:
            docs = keep(docs, "clean")
            held.destroy()
    return docs
