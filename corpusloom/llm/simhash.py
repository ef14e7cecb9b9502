"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries under a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import gather, hot_join, keep, slices, spread
from corpusloom.llm.components import components, settle

SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (uint64) of each word shingle in order, repeats included; a shorter text is one shingle. No word: none."""
    words = (text or "").encode().lower().split()  # bytes.lower() and split() know A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    return np.fromiter((digest(data[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """64 bits; a bit is 1 if set in over half the hashes. No hash: 0."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The majority bits of the XXH64 hashes of the word shingles, repeats included. No word: 0."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long: the 64 bits as a signed number), a row for each document."""
    fields = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            own = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64), pa.int64())], names=fields.names)

    return spread(docs.select(id_column, text_column)).mapInArrow(run, fields)


# ---- the trie join within one task


def trie_links(keys: np.ndarray, groups: np.ndarray, prints: np.ndarray, budget: int, leaf: int = 256, most: int = 1 << 21) -> np.ndarray:
    """label[i]: the smallest position linked to i by prints (uint64) of the same group with at most `budget` differing bits.

    keys (uint64) are the prints' bits below the root, sorted within groups. Nodes of each group's binary trie are ranges of positions. Pairs of nodes
    go down together, bit by bit: the pair's differing bits are summed, and it is dropped when they exceed the
    budget, or when all its members are linked already. Pairs of few members are compared at once, in portions.
    """
    n = len(keys)
    label = np.arange(n, dtype=np.int64)
    if n < 2:
        return label
    edges = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    lo, hi = edges[:-1], edges[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    alo, ahi, blo, bhi, spent = lo, hi, lo, hi, np.zeros(len(lo), np.int64)
    for depth in range(65):
        if not len(alo):
            break
        small = (ahi - alo) * (bhi - blo) <= leaf if depth < 64 else np.ones(len(alo), bool)
        sizes = ((ahi - alo) * (bhi - blo))[small]
        la, lb, lw = alo[small], blo[small], (bhi - blo)[small]
        portion = np.cumsum(sizes) // most
        for k in range(int(portion[-1]) + 1 if len(portion) else 0):
            p = portion == k
            which = np.repeat(np.flatnonzero(p), sizes[p])
            inner = gather(np.zeros(int(p.sum()), np.int64), sizes[p])
            i, j = la[which] + inner // lw[which], lb[which] + inner % lw[which]
            near = (i < j) & (np.bitwise_count(prints[i] ^ prints[j]) <= budget)
            settle(label, i[near], j[near])
        alo, ahi, blo, bhi, spent = (x[~small] for x in (alo, ahi, blo, bhi, spent))
        if not len(alo):
            break
        # all members of the pair linked already: nothing to add below
        padded = np.concatenate([label, [0]])
        span = lambda f, x, y: f.reduceat(padded, np.stack([x, y], 1).ravel())[::2]
        one = np.minimum(span(np.minimum, alo, ahi), span(np.minimum, blo, bhi)) == np.maximum(span(np.maximum, alo, ahi), span(np.maximum, blo, bhi))
        alo, ahi, blo, bhi, spent = (x[~one] for x in (alo, ahi, blo, bhi, spent))
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)])
        cut = lambda x, y: y - (ones[y] - ones[x])
        am, bm, own = cut(alo, ahi), cut(blo, bhi), alo == blo
        parts = [(alo, am, blo, bm, spent), (am, ahi, bm, bhi, spent), (alo, am, bm, bhi, spent + 1), (am[~own], ahi[~own], blo[~own], bm[~own], spent[~own] + 1)]
        alo, ahi, blo, bhi, spent = (np.concatenate([p[c] for p in parts]) for c in range(5))
        live = (spent <= budget) & (ahi > alo) & (bhi > blo) & ~((alo == blo) & (ahi - alo < 2))
        alo, ahi, blo, bhi, spent = (x[live] for x in (alo, ahi, blo, bhi, spent))
    return label


def _join_groups(budget: int):
    """Arrow function over rows (grp, key, fp) sorted by grp, key: a link (u, v) for each row that is not its component's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def links(rows: list[np.ndarray]) -> pa.RecordBatch:
            label = trie_links(rows[1].view(np.uint64) ^ np.uint64(1 << 63), rows[0], rows[2].view(np.uint64), budget)
            tied = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(rows[2][tied], pa.int64()), pa.array(rows[2][label[tied]], pa.int64())], names=["u", "v"])

        for batch in batches:
            rows = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on
            if cut:
                yield links([r[:cut] for r in rows])
            held = [r[cut:] for r in rows]
        if len(held[0]):
            yield links(held)

    return run


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """`parts` consecutive (start, width) blocks that cover the bits."""
    edges = [round(i * bits / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _rooted(rows: DataFrame, bits: int, budget: int) -> DataFrame:
    """Root each row's remaining bits (the high bits of key) at each of budget+1 blocks: near pairs agree on one block at least.

    grp becomes a hash of the old grp, the block and its value; key loses the block and turns what stood before it to the end.
    """
    roots = []
    for i, (s, w) in enumerate(_blocks(bits, budget + 1)):
        value = F.shiftrightunsigned(F.shiftleft("key", s), 64 - w)
        after = F.shiftleft("key", s + w) if s + w < 64 else F.lit(0).cast("long")
        before = F.shiftleft(F.shiftrightunsigned("key", 64 - s), 64 - bits + w) if s else F.lit(0).cast("long")
        roots.append(F.struct(F.xxhash64("grp", F.lit(i), value).alias("grp"), after.bitwiseOR(before).alias("key")))
    return rows.select("fp", F.explode(F.array(*roots)).alias("root")).select("root.grp", "root.key", "fp")


def links(prints: DataFrame, budget: int = 3, most_in_group: int = 20_000) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) whose components are those of all pairs within the budget.

    Groups are tries rooted at a block of 16 bits (for a budget of 3): pairs within the budget agree on one of
    the four blocks. A root that holds more than most_in_group fingerprints is rooted again at blocks of its remaining
    bits, as often as needed, so that no task gathers a hot root. Group numbers are hashes; two roots that
    share one only lie in one trie together, since whole fingerprints are compared at its leaves.
    """
    bits, rows, done = 64, prints.select(F.lit(0).cast("long").alias("grp"), F.col("fp").alias("key"), "fp"), []
    while True:
        rows = _rooted(rows, bits, budget)
        bits -= min(w for _, w in _blocks(bits, budget + 1))
        sizes = rows.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > most_in_group).select("grp")
        if 1 << min(bits, 60) <= most_in_group or sizes.isEmpty():
            done.append(rows)
            break
        hot = keep(sizes, "hot-roots")
        done.append(rows.join(hot, "grp", "left_anti"))
        rows = keep(rows.join(hot, "grp", "left_semi"), "hot-rows")
    out = None
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    for rows in done:
        # the key's sign bit is turned so that signed order is the order of the bits
        own = rows.select("grp", F.expr("key ^ (-9223372036854775807L - 1L)").alias("key"), "fp").repartition("grp").sortWithinPartitions("grp", "key")
        own = own.mapInArrow(_join_groups(budget), schema)
        out = own if out is None else out.unionByName(own)
    return out


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, budget: int = 3, most_in_group: int = 20_000) -> DataFrame:
    """(id, fp long, component_id): documents whose fingerprints are linked through at most `budget` differing bits share a component.

    One row for each input row; component_id is the smallest id reachable, the row's own included. Equal fingerprints
    meet as one (with their smallest id) before the join, so a group of copies costs one row there. Fingerprints and components that very
    many rows share are joined by a bounded broadcast, the others by a shuffle (common.hot_join).
    A null, empty or blank text has fingerprint zero and is linked like any other. Repeated rows stay, in one component. A null id
    never becomes a component_id unless all of its component are null. An empty table gives no rows. Other columns are not read.
    """
    prints = keep(fingerprints(docs, id_column, text_column, shingle), "prints")
    reps = keep(prints.groupBy("fp").agg(F.min(id_column).alias("rep"), F.count("*").alias("n")), "reps")
    tied = keep(components(keep(links(reps.select("fp"), budget, most_in_group), "links")), "tied")  # (node, root) of linked fingerprints
    own = tied.join(reps.select(F.col("fp").alias("node"), "rep"), "node")
    least = own.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    moved = hot_join(tied, least, "root").select(F.col("node").alias("fp"), "least")
    named = keep(reps.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), "n"), "named")
    return hot_join(prints, named, "fp").select(id_column, "fp", "component_id")
