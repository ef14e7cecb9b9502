"""Best-fit packing by patterns: few-document length patterns, repeat counts by non-negative least squares, residuals packed best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.bpe import tokenizer
from corpusloom.llm.common import keep, slices, spread


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n >= 1 ids: whole if they fit, else full pieces after a first one that may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


# ---- the plan: from a histogram of lengths alone, so on the driver; its size is bounded by the capacity


def patterns(present: list[int], capacity: int) -> list[tuple[int, ...]]:
    """All pairs and triples of present lengths that fill a sequence exactly, longest document first."""
    have, out = set(present), []
    for a in sorted(present, reverse=True):
        if capacity - a <= a and capacity - a in have:
            out.append((a, capacity - a))
    for a in sorted(present, reverse=True):
        rest = capacity - a
        out += [(a, b, rest - b) for b in range(min(a, rest - 1), (rest - 1) // 2, -1) if b in have and rest - b in have]
    return out


def fit(columns: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = 6) -> list[float]:
    """x >= 0 that makes the patterns' summed lengths nearest to the histogram in least squares, by coordinate descent."""
    left = dict.fromkeys({ln for c in columns for ln in c}, 0.0) | {k: float(v) for k, v in counts.items()}
    x = [0.0] * len(columns)
    times = [{ln: c.count(ln) for ln in c} for c in columns]
    norm = [sum(m * m for m in t.values()) for t in times]
    for _ in range(sweeps):
        moved = 0.0
        for j, t in enumerate(times):
            step = max(-x[j], sum(m * left[ln] for ln, m in t.items()) / norm[j])
            if step:
                x[j] += step
                moved += abs(step)
                for ln, m in t.items():
                    left[ln] -= m * step
        if moved < 0.5:
            break
    return x


def residual(left: dict[int, int], capacity: int, above: int = 0) -> Iterator[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts, while a length over `above` is left: each pattern is repeated as often as its lengths last."""
    lengths = sorted(k for k, v in left.items() if v)
    while lengths and lengths[-1] > above:
        took: dict[int, int] = {}
        room = capacity
        for ln in reversed(lengths):
            if n := min(left[ln], room // ln):
                took[ln] = n
                room -= n * ln
            if room < lengths[0]:
                break
        times = min(left[ln] // n for ln, n in took.items())
        yield tuple(ln for ln, n in took.items() for _ in range(n)), times
        for ln, n in took.items():
            left[ln] -= n * times
        lengths = [ln for ln in lengths if left[ln]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram exactly; no pattern is longer than the capacity.

    First the patterns around a length over half the capacity, of which no two share a sequence, and best fit for what is left
    of those; then the patterns of shorter lengths, fitted to what remains, and best fit again.
    """
    left = {ln: n for ln, n in counts.items() if n}
    out = [((capacity,), left.pop(capacity))] if capacity in left else []
    for above, least in ((capacity // 2, capacity // 2), (0, 0)):
        columns = [c for c in patterns([ln for ln, n in left.items() if n], capacity) if c[0] > above]
        for x, column in sorted(zip(fit(columns, left), columns, strict=True), key=lambda p: (-p[0], p[1])):
            n = min(int(x + 1e-9), min(left[ln] // column.count(ln) for ln in set(column)))
            if n > 0:
                out.append((column, n))
                for ln in column:
                    left[ln] -= n
        out += residual(left, capacity, least)
    return out


def segments(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: ranks of one length go to the patterns in turn."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for column, n in planned:
        at = 0
        for ln in column:
            rows.append((ln, used.get(ln, 0), sequence, at))
            used[ln] = used.get(ln, 0) + n
            at += ln
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# ---- the DataFrame side


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32[, ids], and (part, rank) of it among its part's pieces of one length."""
    fields = [T.StructField(id_column, docs.schema[id_column].dataType), *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))), *([T.StructField("ids", T.BinaryType())] if with_ids else []), T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = tokenizer(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, text_column):
            ids, offsets = bpe.encode(batch.column(1).to_pylist(), end_id)
            doc, piece, start, length, crc, raw, rank = [], [], [], [], [], [], []
            data = memoryview(ids.astype("<u4").tobytes())
            for d, (lo, hi) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                for k, (s, n) in enumerate(piece_bounds(hi - lo, capacity)):
                    own = data[4 * (lo + s) : 4 * (lo + s + n)]
                    doc.append(d), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(own)), rank.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        raw.append(bytes(own))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(raw, pa.binary())] if with_ids else []), pa.array([part] * len(doc), pa.int32()), pa.array(rank, pa.int64())], names=[f.name for f in fields])

    return spread(docs.select(id_column, text_column)).mapInArrow(cut, T.StructType(fields))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack whole documents into as few sequences of at most `capacity` ids as the plan finds.

    Returns a row for each piece: id, piece, start, length, ids_crc32[, ids: little-endian unsigned 32-bit],
    sequence_id, offset. Texts are tokenised once; the pieces are written to the shared folder, and only
    the histogram of lengths (at most `capacity` counts) goes to the driver. Ranks within a length come
    from counts by (part, length), so a length that a third of all pieces share is never gathered.

    A null or empty text is the end id alone. Longer documents than the capacity are cut into full pieces
    with a shorter first one. Repeated rows and ids are documents of their own. An empty table gives no rows.
    Columns besides id and text are not read.
    """
    cut = keep(pieces(docs, tokenizer_path, capacity, end_id, id_column, text_column, with_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = segments(plan(histogram, capacity))
    keys = (table[:, 0] << 44) + table[:, 1] if len(table) else np.zeros(0, np.int64)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = cut.join(before, ["part", "length"]).select(id_column, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), (F.col("rank") + F.col("before")).alias("rank"))
    fields = [*(f for f in ranked.schema if f.name != "rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = (col[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            row = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            sequence, offset = table[row, 2] + rank - table[row, 1], table[row, 3]
            yield pa.RecordBatch.from_arrays([*(c for n, c in col.items() if n != "rank"), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[f.name for f in fields])

    return ranked.mapInArrow(place, T.StructType(fields))
