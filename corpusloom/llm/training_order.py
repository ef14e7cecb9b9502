"""Training-order materialisation: a keyed Feistel permutation gives every sequence a global slot; fixed-stride shards hold them in slot order."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.bpe import tokenizer
from corpusloom.llm.common import keep, slices, spread

ROUNDS = 6
LEVEL = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, half: int, keys: list[np.uint64], back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left ^ key) & mask), left
        else:
            left, right = right, left ^ (_mix(right ^ key) & mask)
    return (left << np.uint64(half)) | right


def permute(ordinals: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A bijection of 0..n-1 chosen by the key: a Feistel network over the next even power of two, walked along its cycles until inside.

    back=True is its inverse. n may be up to 2^62.
    """
    half = max(1, -(-max(1, (max(n, 2) - 1).bit_length()) // 2))
    with np.errstate(over="ignore"):
        keys = [_mix(np.array([(key + r * 0x9E3779B97F4A7C15) & (1 << 64) - 1], np.uint64))[0] for r in range(1, ROUNDS + 1)]
        x = np.asarray(ordinals, np.uint64)
        x = _network(x, half, keys, back)
        while (out := x >= np.uint64(n)).any():
            x[out] = _network(x[out], half, keys, back)
    return x.astype(np.int64)


def sequences(docs: DataFrame, tokenizer_path: str, stride: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(part, idx, n_ids, ids: little-endian unsigned 16- or 32-bit, crc: of these bytes, doc_ids): each split's token stream, an end id after every document, cut every `stride` ids.

    Only a split's last sequence may be shorter. doc_ids: the documents with ids in it, in order.
    """
    fields = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("idx", T.LongType()), T.StructField("n_ids", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("crc", T.LongType()), T.StructField("doc_ids", T.ArrayType(docs.schema[id_column].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, idx = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        rest, open_docs, kind = np.zeros(0, np.uint32), [], pa.null()

        def rows(ids: np.ndarray, docs_in: list[list], first: int) -> pa.RecordBatch:
            n = len(docs_in)
            wide = ids.astype(width(bpe.size))
            cuts = [wide[k * stride : (k + 1) * stride].tobytes() for k in range(n)]
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array([len(c) // wide.itemsize for c in cuts], pa.int32()), pa.array(cuts, pa.binary()), pa.array(map(zlib.crc32, cuts), pa.int64()), pa.array(docs_in, pa.list_(kind))], names=fields.names)

        for batch in slices(batches, text_column):
            kind = batch.column(0).type
            ids, offsets = bpe.encode(batch.column(1).to_pylist(), end_id)
            own = batch.column(0).to_pylist()
            starts = np.concatenate([np.zeros(len(open_docs), np.int64), offsets[:-1] + len(rest)])
            ends = np.concatenate([np.full(len(open_docs), len(rest)), offsets[1:] + len(rest)])
            names, stream = open_docs + own, np.concatenate([rest, ids])
            n = len(stream) // stride
            lo, hi = np.searchsorted(ends, np.arange(n + 1) * stride, side="right"), np.searchsorted(starts, np.arange(1, n + 2) * stride, side="left")
            if n:
                yield rows(stream[: n * stride], [names[lo[k] : hi[k]] for k in range(n)], idx)
            idx, rest, open_docs = idx + n, stream[n * stride :], names[lo[n] :] if len(stream) > n * stride else []
        if len(rest):
            yield rows(rest, [open_docs], idx)

    return spread(docs.select(id_column, text_column)).mapInArrow(run, fields)


def width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _pack(slots: list[int], counts: list[int], rows: list[bytes]) -> bytes:
    head = struct.pack("<q", len(slots)) + np.array(slots, "<i8").tobytes() + np.array(counts, "<i4").tobytes()
    return zstandard.compress(head + b"".join(rows), LEVEL)


def _unpack(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data = zstandard.decompress(blob)
    (n,) = struct.unpack_from("<q", data)
    slots, counts = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i4", n, 8 + 8 * n)
    ends = 8 + 12 * n + np.cumsum(counts.astype(np.int64)) * size
    return slots, counts, [data[e - c * size : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def materialise(docs: DataFrame, tokenizer_path: str, out_dir: str, key: int, stride: int = 1024, shard_rows: int = 16_384, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", vocabulary: int = 50_257) -> tuple[DataFrame, DataFrame]:
    """Write all sequences in the key's order to a run's own folder in out_dir; returns (index of sequences, manifest of shards).

    index: ordinal, slot, shard, byte_offset, n_ids, ids_crc32, doc_ids. manifest: shard, first_slot, n_rows, n_bytes, crc32, path.
    Slot s is record s % shard_rows of shard s // shard_rows. A record is `stride` ids, padded with end ids; the index has its true count. So reading
    can begin at any slot, and goes on sequentially. Texts are tokenised once; the sequences are kept in the shared folder, and one
    count for each input split goes to the driver. A task sends each shard compressed blocks of its records; a shard is filled by
    record number, in memory of one shard; each range of slots is a partition of its own. The folder's name is a digest of the sequences, the key and
    the layout, so another key or other documents never meet files of this run. Files are written under a temporary name and moved: a repeated task or a
    resumed run finds a whole file and leaves it. out_dir is a path or URI that pyarrow's file systems know and all executors share.

    The same input splits, key and stride give the same order. A null or empty text is the end id alone. Repeated rows are documents of their own. An
    empty table writes no shard. Columns besides id and text are not read.
    """
    spark = docs.sparkSession
    kept = keep(sequences(docs, tokenizer_path, stride, end_id, id_column, text_column), "sequences", **{"compression": "zstd", "parquet.compression.codec.zstd.level": "9"})
    found = sorted(map(tuple, kept.groupBy("part").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("idx", "n_ids", "crc")).alias("x"), F.sum(F.pmod(F.xxhash64("crc", "idx"), F.lit(1 << 31))).alias("s")).collect()))
    counts = [f[:2] for f in found]
    n = sum(c for _, c in counts)
    run = f"run-{hashlib.sha256(repr((found, key, stride, shard_rows, end_id, vocabulary)).encode()).hexdigest()[:16]}"
    bases = spark.sparkContext.broadcast(dict(zip((p for p, _ in counts), np.cumsum([0, *(c for _, c in counts)])[:-1].tolist(), strict=True)))
    dtype = np.dtype(width(vocabulary))
    slot_of = lambda part, idx: permute(np.array([bases.value[p] for p in part.tolist()], np.int64) + idx, n, key)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        size = 0

        def flush():
            shards = list(held)
            blobs = [_pack(*held[s]) for s in shards]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

        for batch in batches:
            slots = slot_of(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            for slot, count, raw in zip(slots.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for a, b in zip(held.setdefault(slot // shard_rows, ([], [], [])), (slot, count, raw), strict=True):
                    a.append(b)
                size += len(raw)
                if size > 32 << 20:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(out_dir)
        base = f"{base.rstrip('/')}/{run}"
        system.create_dir(base, recursive=True)
        now, table = None, None

        def ended() -> pa.RecordBatch:
            data = table.tobytes()
            path = f"{base}/shard-{now:08d}.bin"
            found = system.get_file_info(path)
            if found.type == fs.FileType.NotFound or found.size != len(data):
                part = f"{base}/.shard-{now:08d}.{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(part) as f:
                    f.write(data)
                system.move(part, path)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((now, pa.int64()), (now * shard_rows, pa.int64()), (len(table), pa.int64()), (len(data), pa.int64()), (zlib.crc32(data), pa.int64()), (path, pa.string()))], names=["shard", "first_slot", "n_rows", "n_bytes", "crc32", "path"])

        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now:
                    if now is not None:
                        yield ended()
                    now = shard
                    table = np.full((min(shard_rows, n - shard * shard_rows), stride), end_id, dtype)
                slots, counts, rows = _unpack(blob.as_buffer(), dtype.itemsize)
                for s, c, raw in zip((slots - now * shard_rows).tolist(), counts.tolist(), rows, strict=True):
                    table[s, :c] = np.frombuffer(raw, dtype)
        if now is not None:
            yield ended()

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, idx = batch.column(0), batch.column(1).to_numpy()
            ordinal = np.array([bases.value[p] for p in part.to_pylist()], np.int64) + idx
            slot = permute(ordinal, n, key)
            yield pa.RecordBatch.from_arrays([pa.array(ordinal), pa.array(slot), pa.array(slot // shard_rows), pa.array(slot % shard_rows * stride * dtype.itemsize), *batch.columns[2:]], names=["ordinal", "slot", "shard", "byte_offset", "n_ids", "ids_crc32", "doc_ids"])

    shards = -(-n // shard_rows)
    sent = kept.select("part", "idx", "n_ids", "ids").mapInArrow(send, "shard long, blob binary")
    written = sent.repartitionById(max(1, shards), F.col("shard").cast("int")).sortWithinPartitions("shard").mapInArrow(fill, "shard long, first_slot long, n_rows long, n_bytes long, crc32 long, path string")
    index = kept.select("part", "idx", "n_ids", "crc", "doc_ids").mapInArrow(indexed, T.StructType([*(T.StructField(c, T.LongType()) for c in ("ordinal", "slot", "shard", "byte_offset")), T.StructField("n_ids", T.IntegerType()), T.StructField("ids_crc32", T.LongType()), kept.schema["doc_ids"]]))
    return index, keep(written, "shards")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read(run_dir: str, first_slot: int = 0, stride: int = 1024, shard_rows: int = 16_384, dtype: str = "<u2") -> Iterator[tuple[int, np.ndarray]]:
    """(slot, padded ids) of a run's folder (that of its manifest's paths) from first_slot on, in slot order; to resume, give the slot after the last one used."""
    system, base = _place(run_dir)
    size, slot = stride * np.dtype(dtype).itemsize, first_slot
    while system.get_file_info(path := f"{base}/shard-{slot // shard_rows:08d}.bin").type == fs.FileType.File:
        with system.open_input_file(path) as f:
            f.seek(slot % shard_rows * size)
            while len(data := f.read(size)) == size:
                yield slot, np.frombuffer(data, dtype)
                slot += 1
        if slot % shard_rows:
            return
