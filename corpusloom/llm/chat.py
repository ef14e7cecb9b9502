"""Chat formatting by columnar byte assembly: segment lengths, offsets and scatter indices in numpy, one preallocated Arrow buffer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import gather, slices, spread

#: The template's control strings. A backslash is doubled in texts, and one is put behind the first sign of a control string.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_BACKSLASH = 0x5C
_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?)</s>|<s>\[ROLE\] (?P<role>.*?)\n(?P<other>.*?)\[/ROLE\]", re.DOTALL)
_STARTS = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return _STARTS.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def marks(role: str | None) -> tuple[str, str]:
    """What stands before and behind a turn's text."""
    if role == "user":
        return "<s>[INST] ", " [/INST]"
    if role == "assistant":
        return " ", "</s>"
    return f"<s>[ROLE] {escape(role or '').replace(chr(10), chr(92) + 'n')}\n", "[/ROLE]"


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, read back from formatted text; a null role or text reads as empty."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}: {formatted[at : at + 40]!r}")
        at = m.end()
        kind = m.lastgroup
        yield (unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind]))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(roles: list[str | None], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, turn offsets, content starts, content ends): all turns formatted end to end as UTF-8 bytes."""
    data, offsets = _bytes_of(texts)
    n, size = len(roles), np.diff(offsets)
    # where a backslash goes in behind a source byte
    found = [np.flatnonzero(data == _BACKSLASH)]
    ends = offsets[1:]
    for first in {c[0] for c in CONTROL}:
        at = np.flatnonzero(data == ord(first))
        if len(at):
            last = ends[np.searchsorted(ends, at, side="right")]
            for control in (c for c in CONTROL if c[0] == first):
                fit = at[at + len(control) <= last]
                for k, sign in enumerate(control[1:].encode(), 1):
                    fit = fit[data[fit + k] == sign]
                found.append(fit)
    after = np.sort(np.concatenate(found))
    grown = np.searchsorted(after, offsets)  # insertions before each text
    known: dict[str | None, int] = {}
    inverse = np.fromiter((known.setdefault(r, len(known)) for r in roles), np.int64, n)
    shown = [tuple(m.encode() for m in marks(r)) for r in known]
    head, foot = (np.array([len(s[i]) for s in shown], np.int64)[inverse] for i in range(2))
    content = size + np.diff(grown)
    ends_at = np.cumsum(head + content + foot)
    upto = np.concatenate([[0], ends_at])
    out = np.empty(int(upto[-1]), np.uint8)
    start = upto[:-1] + head
    for k, (h, f) in enumerate(shown):
        own = np.flatnonzero(inverse == k)
        for at, mark in ((upto[own], h), (upto[own + 1] - len(f), f)):
            out[gather(at, np.full(len(own), len(mark)))] = np.tile(np.frombuffer(mark, np.uint8), len(own))
    place = gather(start, size)
    if len(after):
        more = np.zeros(len(data) + 1, np.int64)
        np.add.at(more, after + 1, 1)
        place += np.cumsum(more)[:-1] - np.repeat(grown[:-1], size)
        out[place[after] + 1] = _BACKSLASH
    out[place] = data
    return out, upto, start, start + content


def format_chats(chats: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", most_bytes: int = 1 << 20) -> DataFrame:
    """Conversations as formatted text with a loss mask over assistant texts.

    Returns (id, chunk long, open boolean, n_turns long, formatted string, loss_start, loss_end: arrays of code point offsets in
    `formatted`). A conversation's text is its chunks in the order of `chunk`; turns are never cut. Rows are dealt by ranges of
    (id, turn, role, hash of text, row), so a conversation that holds a third of all rows spreads over tasks; `open` is false only for
    chunks known to be whole conversations. Chunks close at about most_bytes.

    Turns of equal number are ordered by role, then by a hash of the text; a null number comes first. Null roles and texts count as empty,
    and rows with a null id form one conversation. Repeated rows stay. An empty table gives no rows. Other columns are not read.
    """
    fields = T.StructType([T.StructField(id_column, chats.schema[id_column].dataType), *(T.StructField(n, t) for n, t in (("chunk", T.LongType()), ("open", T.BooleanType()), ("n_turns", T.LongType()), ("formatted", T.StringType()), ("loss_start", T.ArrayType(T.LongType())), ("loss_end", T.ArrayType(T.LongType()))))])
    keys = [F.col("i").asc_nulls_first(), F.col("t").asc_nulls_first(), F.col("r").asc_nulls_first(), F.col("h"), F.col("n")]
    rows = chats.select(F.col(id_column).alias("i"), F.col(turn_column).alias("t"), F.col(role_column).alias("r"), F.coalesce(F.col(text_column), F.lit("")).alias("x"), F.xxhash64(text_column).alias("h"), F.monotonically_increasing_id().alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, first = TaskContext.get().partitionId() << 32, None, True
        for batch in slices(batches, "x", most_bytes):
            ids, roles = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out, upto, lo, hi = assemble(roles, batch.column(3))
            new = np.array([True, *(a != b for a, b in zip(ids, ids[1:], strict=False))])
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(ids))
            signs = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
            answer = np.array([r == "assistant" for r in roles])
            per = np.add.reduceat(answer.astype(np.int64), begins)
            base = np.repeat(signs[upto[begins]], per)
            spans = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), pa.array(signs[x[answer]] - base, pa.int64())) for x in (lo, hi)]
            text = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(upto[begins], upto[-1]).astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            open_ = np.zeros(len(begins), bool)
            open_[-1] = True  # it may go on in the next batch
            open_[0] = first or (held is not None and held == (ids[0],))
            first, held = False, (ids[-1],)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(begins)), pa.array(number + np.arange(len(begins)), pa.int64()), pa.array(open_), pa.array(ends - begins, pa.int64()), text, *spans], names=fields.names)
            number += len(begins)

    parts = int(chats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("i", "t", "r", "x").mapInArrow(run, fields)


def digests(formatted: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Per conversation, read back from formatted chunks: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Whole conversations are read where they lie; only open chunks are dealt by id and read in order, with a running
    hash, so that no conversation is held in memory.
    """
    fields = T.StructType([T.StructField(id_column, formatted.schema[id_column].dataType), *(T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f) for i, f in enumerate(kinds)], names=fields.names)

        def ended():
            return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        kinds = None
        for batch in slices(batches, "formatted"):
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            for key, text, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now != (key,):
                    if now:
                        done.append(ended())
                    now, state = (key,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s, e in zip(lo, hi, strict=True):
                    said = unescape(text[s:e])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield row(done)
        if now:
            yield row([ended()])

    columns = [id_column, "formatted", "loss_start", "loss_end"]
    whole = formatted.filter("not open").select(*columns).mapInArrow(run, fields)
    parts = formatted.filter("open").repartition(id_column).sortWithinPartitions(F.col(id_column).asc_nulls_first(), "chunk").select(*columns).mapInArrow(run, fields)
    return whole.unionByName(parts)
