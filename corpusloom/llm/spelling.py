"""Spelling variants: words one edit apart share a half, so they meet in a block of the forward dictionary (a shared prefix) or of the reversed one (a shared suffix).

Blocks that hold many words are subdivided: what the members do not share is halved again, and again one half of it is intact. So a pair is found
without comparing all words of a frequent beginning or ending, and none is lost.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import keep, slices

#: In UTF-8 after lower-casing A-Z: a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
BREAK = re.compile(rb"[^a-z\x80-\xff]")
KEY = ("m", "p", "s", "below", "head", "tail")
UNBOUND = 1 << 30


def _pieces(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """data in pieces of about `most` bytes, cut where no run can be."""
    lo = 0
    while len(data) - lo > most:
        cut = BREAK.search(data, lo + most)
        if not cut:
            break
        yield data[lo : cut.start()]
        lo = cut.start()
    yield data[lo:]


def _count(data: bytes, prefix: int, every: int, least: int, into: Counter) -> None:
    for word, n in Counter(RUN.findall(data)).items():
        h = zlib.crc32(word, prefix)
        if h % every == 0:
            said = word.decode()
            at = h % len(said)
            word = (said[:at] + said[at + 1 :]).encode()
        if len(word) >= least and (word.isascii() or len(word.decode()) >= least):
            into[word] += n


def dictionary(docs: DataFrame, least_length: int = 6, least_n: int = 5, every: int = 199) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, with at least least_length code points and least_n occurrences.

    An occurrence whose crc32 of `<doc_id>:<word>` is divisible by `every` loses the code point at that number modulo its length. Null texts have no
    words; a null id stands as nothing before the colon; repeated rows count each. Words are counted within each batch before they are shuffled.
    Columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for piece in _pieces(text.encode().lower()) if text else ():
                    _count(piece, prefix, every, least_length, held)
                if len(held) > 1 << 18:
                    yield flush()
        if held:
            yield flush()

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return keep(found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n), "dictionary")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows with their block's key: m, the longer length of its pairs; p and s, how much of both ends is shared; the shared ends themselves."""
    return rows.withColumn("head", F.expr("substring(word, 1, p)")).withColumn("tail", F.expr("substring(word, length(word) - s + 1, s)"))


def candidates(words: DataFrame, most: int = 32) -> DataFrame:
    """(word, n, and KEY): every two words one edit apart share a block, and a block has at most `most` words, or shares all but one code point.

    A pair whose longer word has m code points has a common prefix or suffix of at least m div 2. A word of length l is therefore dealt to blocks of
    m = l and m = l + 1 by its first and by its last m div 2 code points. Larger blocks are counted (partial aggregates; their rows are not gathered) and
    their words dealt again by one half more of the rest; there are as many rounds as the longest word can be halved. `below` bounds the common prefix of
    pairs that count in a block: those with a longer one belong to the block on the prefix side, so each pair counts in one block.
    """
    half = F.expr("m div 2")
    base = words.select("word", "n", F.explode(F.expr("array(length(word), length(word) + 1)")).alias("m"))
    none, unbound = F.lit(0), F.lit(UNBOUND)
    sides = F.array(F.struct(half.alias("p"), none.alias("s"), unbound.alias("below")), F.struct(none.alias("p"), half.alias("s"), half.alias("below")))
    deal = lambda rows, sides: _blocks(rows.select("word", "n", "m", F.explode(sides).alias("side")).select("word", "n", "m", *(F.col(f"side.{c}").cast("int").alias(c) for c in ("p", "s", "below"))))
    rows, done = keep(deal(base, sides), "blocks"), []
    while True:
        large = keep(rows.filter("m - p - s > 1").groupBy(*KEY).agg(F.count("*").alias("size")).filter(F.col("size") > most), "large-blocks")
        if large.isEmpty():
            return _union([*done, rows])
        sized = keep(rows.join(large, list(KEY), "left"), "blocks")
        done.append(sized.filter("size is null").drop("size"))
        more = F.expr("(m - p - s) div 2")
        sides = F.array(
            F.struct((F.col("p") + more).alias("p"), F.col("s").alias("s"), F.col("below").alias("below")),
            F.struct(F.col("p").alias("p"), (F.col("s") + more).alias("s"), F.least(F.col("below"), F.col("p") + more).alias("below")),
        )
        rows = keep(deal(sized.filter("size is not null"), sides), "blocks")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near(a: str, b: str, shared: int, below: int) -> bool:
    """Whether b, as long as a or longer by one, is one edit from a, given a shared prefix, and their common prefix is shorter than `below`."""
    at = shared
    while at < len(a) and a[at] == b[at]:
        at += 1
    return at < below and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in sorted order to (word, n_near, best_n, best): what each word is linked with in a block."""
    out: dict[str, list] = {c: [] for c in ("word", "n_near", "best_n", "best")}

    def settle(block: list[tuple[str, int]], m: int, p: int, below: int) -> None:
        found: dict[str, list] = {}
        longer, shorter = ([x for x in block if len(x[0]) == k] for k in (m, m - 1))
        pairs = ((a, b) for j, b in enumerate(longer) for a in (*longer[:j], *shorter))
        for (a, x), (b, y) in pairs:
            if near(a, b, p, below):
                for word, other in ((a, (-y, b)), (b, (-x, a))):
                    held = found.setdefault(word, [0, other])
                    held[0] += 1
                    held[1] = min(held[1], other)
        for word, (count, (best_n, best)) in found.items():
            for c, v in zip(out.values(), (word, count, -best_n, best), strict=True):
                c.append(v)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(v, pa.string() if c in ("word", "best") else pa.int64()) for c, v in out.items()], names=list(out))
        for v in out.values():
            v.clear()
        return batch

    now, block = None, []
    for batch in batches:
        for word, n, m, p, s, below in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = (m, p, s, below, word[:p], word[len(word) - s :])
            if key != now:
                if len(block) > 1:
                    settle(block, now[0], now[1], now[3])
                now, block = key, []
            block.append((word, n))
        if out["word"]:
            yield flush()
    if len(block) > 1:
        settle(block, now[0], now[1], now[3])
    if out["word"]:
        yield flush()


def links(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for words with near words: how many, and the one of largest n, the smallest in code-point order among equals."""
    blocks = candidates(words)
    # sorted ranges: the forward dictionary's blocks, then the reversed one's; equal keys never part
    order = ["s", "m", "p", "below", "head", "tail"]
    found = blocks.repartitionByRange(*order).sortWithinPartitions(*order).select("word", "n", "m", "p", "s", "below").mapInArrow(_scan, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.best").alias("best"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a dictionary (word, n), words distinct.

    form: the near word of largest n, if that is at least `ratio` times (over 1) the word's own. root: where following forms ends, by doubling the
    steps in each round; n grows by `ratio` with each form, which bounds the rounds. Words without near words stand with n_near 0. An empty dictionary gives no rows.
    """
    found = words.join(links(words), "word", "left")
    kept = F.col("best_n") >= F.col("n") * ratio
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(kept, F.col("best")).alias("form"), F.when(kept, F.col("best_n")).alias("form_n"))
    found = keep(found, "forms")
    most, least = found.agg(F.max("n"), F.min("n")).first()
    steps = math.floor(math.log(most / max(1, least), ratio)) + 1 if most else 0
    hops = found.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = keep(hops.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return found.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
