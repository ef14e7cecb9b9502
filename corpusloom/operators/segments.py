"""A maintained search index: immutable segments of postings with tombstones, additive corpus sums, and a manifest that names the live segments.

A batch of changes writes one small segment; nothing that stands is rewritten until segments are merged. A query reads the buckets of its own terms in
the live segments and drops what a later segment has replaced.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.index import Index, bucket_of, listed, texts, unlisted
from corpusloom.sources import shared


@dataclass(frozen=True)
class Manifest:
    """segments: (name, seq), oldest first; rows and length: of all live rows; applied: names of the batches that are in; schema: of the rows."""

    version: int = 0
    segments: list = field(default_factory=list)
    rows: int = 0
    length: int = 0
    applied: list = field(default_factory=list)
    schema: str = ""


class Segments:
    """An index under a folder. Rows are indexed by `key`; an `owner` (a document, a term) is what is replaced or deleted, with all its rows.

    postings/segment=<name>: term, lists of keys, lens, cols and poss, seq by bucket of the term; a null term lists all rows
    and their owners. rows/segment=<name>: the rows as given, sorted by key. owners/segment=<name>: owner, n_rows, length. gone/segment=<name>: owners that lose what earlier segments hold of them;
    dead/segment=<name>: the keys of their rows there. manifests/<version>: written at once; the highest version counts, so readers see a batch whole or not at all, and of two writers of one version the second fails. What a crash leaves behind is in no manifest; vacuum() deletes it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, owner: str, columns: list[str], stemmed: bool = False, buckets: int = 64):
        self.spark, self.path, self.key, self.owner, self.columns, self.stemmed, self.buckets = spark, path.rstrip("/"), key, owner, columns, stemmed, buckets
        self.keys = list(dict.fromkeys([owner, key]))

    def manifest(self) -> Manifest:
        found = shared.names(self.spark, f"{self.path}/manifests")
        return Manifest(**json.loads(shared.read_text(self.spark, f"{self.path}/manifests/{found[-1]}"))) if found else Manifest()

    def _commit(self, new: Manifest) -> None:
        shared.commit_text(self.spark, f"{self.path}/manifests/{new.version:012d}.json", json.dumps(asdict(new)))

    def _read(self, kind: str, segments: list, schema: str) -> DataFrame:
        """A table of the given segments with their seq; its types are those of the rows, so segments without files are read too."""
        of = {f.name: f.dataType.simpleString() for f in T.StructType.fromJson(json.loads(schema))}
        own = {
            "postings": {"term": "string", "keys": f"array<{of[self.key]}>", "lens": "array<int>", "cols": "array<tinyint>", "poss": "array<int>", "owners": f"array<{of[self.owner]}>"}, "dead": {self.key: of[self.key]},
            "rows": of, "owners": {self.owner: of[self.owner], "n_rows": "bigint", "length": "bigint"}, "gone": {self.owner: of[self.owner]},
        }[kind] | {"seq": "int", "segment": "string"} | ({"bucket": "int"} if kind == "postings" else {})
        read = self.spark.read.schema(", ".join(f"`{c}` {t}" for c, t in own.items())).option("basePath", f"{self.path}/{kind}")
        return read.parquet(*(f"{self.path}/{kind}/segment={name}" for name, _ in segments)).drop("segment")

    def _live(self, rows: DataFrame, segments: list, schema: str, gone: str = "gone") -> DataFrame:
        """Rows of segments whose owner (gone: "dead": whose key) no later one of them has replaced; a segment's tombstones don't touch its own rows."""
        if len(segments) < 2:
            return rows
        by = self.key if gone == "dead" else self.owner
        last = self._read(gone, segments[1:], schema).groupBy(by).agg(F.max("seq").alias("last"))
        return rows.join(last, by, "left").filter("last is null or seq >= last").drop("last")

    def _write(self, kind: str, name: str, seq: int, df: DataFrame) -> None:
        """Each task writes a file for each bucket at once: no shuffle, and no sort that would spill; small row groups bound what the open files hold, and no dictionaries are made of numbers that hardly recur. Tasks are splits of the rows as written, so few files are small."""
        df = (df.sortWithinPartitions(self.key) if kind == "rows" else df).withColumn("seq", F.lit(seq))
        path, conf, most = f"{self.path}/{kind}/segment={name}", self.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
        if kind != "postings":
            df.write.option("compression", "zstd").parquet(path)
            return
        held = conf.get(most)
        conf.set(most, self.buckets + 1)
        try:
            files = df.withColumn("bucket", bucket_of(self.buckets)).write.option("compression", "zstd").option("parquet.block.size", 1 << 21).option("parquet.page.size", 1 << 17).option("parquet.enable.dictionary", "false")
            files.partitionBy("bucket").parquet(path)
        finally:
            conf.set(most, held)

    def _of_rows(self, rows: DataFrame, name: str, seq: int, schema: str) -> DataFrame:
        """Write rows, postings and owners; the rows as written. They are worked out once, the rest is made of what was written."""
        self._write("rows", name, seq, rows)
        rows = self._read("rows", [(name, seq)], schema).drop("seq")
        self._write("postings", name, seq, listed(texts(rows, self.keys, self.columns), self.key, self.owner, self.stemmed))
        # Spark's hash of null is its seed, 42
        lists = self._read("postings", [(name, seq)], schema).filter((F.col("bucket") == 42 % self.buckets) & F.col("term").isNull())
        own = lists.select(F.inline(F.arrays_zip("owners", "lens")).alias(self.owner, "len"))
        self._write("owners", name, seq, own.groupBy(self.owner).agg(F.count("*").alias("n_rows"), F.sum(F.col("len").cast("long")).alias("length")))
        return rows

    def _lost(self, name: str, seq: int, gone: DataFrame, before: list, schema: str) -> None:
        """Write the owners that lose what the segments before hold of them, and the keys of their rows there."""
        self._write("gone", name, seq, gone.distinct() if before else gone.limit(0))
        rows = self._read("rows", before or [(name, seq)], schema).select(*self.keys, "seq")
        dead = self._live(rows, before, schema).join(self._read("gone", [(name, seq)], schema).select(self.owner), self.owner, "left_semi") if before else rows.limit(0)
        self._write("dead", name, seq, dead.select(self.key))

    def _sums(self, owners: DataFrame) -> tuple[int, int]:
        row = owners.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        return row["rows"], row["length"]

    def _next(self, held: Manifest) -> tuple[str, int]:
        seq = held.segments[-1][1] + 1 if held.segments else 1
        return f"{seq:08d}-{uuid.uuid4().hex}", seq

    def rebuild(self, rows: DataFrame) -> Manifest:
        """The index of these rows alone, all anew; batches applied before count as applied no more."""
        held, schema = self.manifest(), rows.schema.json()
        name, seq = self._next(held)
        self._lost(name, seq, self._of_rows(rows, name, seq, schema).select(self.owner), [], schema)
        new = Manifest(held.version + 1, [[name, seq]], *self._sums(self._read("owners", [(name, seq)], schema)), [], schema)
        self._commit(new)
        return new

    def apply(self, batch: str, rows: DataFrame, gone: DataFrame | None = None) -> bool:
        """Commit a batch once; False if it is in already. rows: all rows of each owner that is new or changed. gone: owners that lose theirs.

        The sums change by the batch's own and by what its owners had, which is read from the owners' tables, not from postings. An owner in both rows and
        gone stays with its rows. Rows without words are indexed like others; those of a null owner are, too, but nothing replaces them. A batch may be empty.
        """
        held = self.manifest()
        if batch in held.applied:
            return False
        if held.segments:
            rows = rows.select(*(f.name for f in T.StructType.fromJson(json.loads(held.schema))))
        schema = held.schema or rows.schema.json()
        name, seq = self._next(held)
        owners = self._of_rows(rows, name, seq, schema).select(self.owner)
        self._lost(name, seq, owners if gone is None else owners.union(gone.select(self.owner)), held.segments, schema)
        n, length = self._sums(self._read("owners", [(name, seq)], schema))
        if held.segments:
            before = self._live(self._read("owners", held.segments, schema), held.segments, schema)
            minus = self._sums(before.join(self._read("gone", [(name, seq)], schema).select(self.owner), self.owner, "left_semi"))
            n, length = n - minus[0], length - minus[1]
        self._commit(Manifest(held.version + 1, [*held.segments, [name, seq]], held.rows + n, held.length + length, [*held.applied, batch], schema))
        return True

    def merge(self, first: int = 0) -> Manifest:
        """Put the live rows of the segments from number `first` on into one; with first = 1 the oldest, large one stays. Scores stay as they are."""
        held = self.manifest()
        own, kept = held.segments[first:], held.segments[:first]
        if len(own) < 2:
            return held
        name, seq = self._next(held)
        self._of_rows(self._live(self._read("rows", own, held.schema), own, held.schema).drop("seq"), name, seq, held.schema)
        for kind, by in (("gone", self.owner), ("dead", self.key)):
            lost = self._read(kind, own, held.schema).select(by).distinct()
            self._write(kind, name, seq, lost if kept else lost.limit(0))
        new = replace(held, version=held.version + 1, segments=[*kept, [name, seq]])
        self._commit(new)
        return new

    def vacuum(self) -> list[str]:
        """Delete segments and manifests that the newest manifest doesn't need; their names. Readers of older manifests must be done."""
        held, dead = self.manifest(), []
        live = {f"segment={n}" for n, _ in held.segments}
        for kind, keep in (("manifests", {f"{held.version:012d}.json"}), *((k, live) for k in ("postings", "rows", "owners", "gone"))):
            for name in shared.names(self.spark, f"{self.path}/{kind}"):
                if name not in keep:
                    fs, p = shared.file_system(self.spark, f"{self.path}/{kind}/{name}")
                    fs.delete(p, True)
                    dead.append(name)
        return dead

    def _held(self) -> Manifest:
        held = self.manifest()
        if not held.segments:
            raise ValueError(f"no index was built at {self.path}")
        return held

    def index(self) -> Index:
        """The live postings as an Index; its plan has the manifest's segments fixed."""
        held = self._held()
        postings = self._live(unlisted(self._read("postings", held.segments, held.schema), self.key), held.segments, held.schema, "dead")
        return Index(self.key, postings, None, self.stemmed, self.buckets, (held.rows, held.length))

    def intact(self) -> bool:
        """Whether every live segment's postings and rows are still there; a shared folder may have been cleaned up."""
        live = {f"segment={n}" for n, _ in self.manifest().segments}
        return bool(live) and all(live <= set(shared.names(self.spark, f"{self.path}/{kind}")) for kind in ("postings", "rows"))

    def rows(self) -> DataFrame:
        """The live rows."""
        held = self._held()
        return self._live(self._read("rows", held.segments, held.schema), held.segments, held.schema).drop("seq")


TERM_COLUMNS = ["domain", "term_type", "entity_type", "canonical_name", "aliases"]


def touched_terms(aliases: DataFrame, pending: DataFrame, slug: str) -> DataFrame:
    """term_id: terms that a source gave an alias, and those that its run flagged (pending: term_id)."""
    return aliases.filter(F.col("slug") == slug).select("term_id").union(pending.select("term_id")).filter("term_id is not null").distinct()


def term_rows(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """A row for each term, its distinct aliases joined by spaces."""
    said = aliases.groupBy("term_id").agg(F.array_join(F.sort_array(F.collect_set("alias")), " ").alias("aliases"))
    return terms.join(said, "term_id", "left").select("term_id", *TERM_COLUMNS[:-1], F.coalesce("aliases", F.lit("")).alias("aliases"))


def rebuild_terms(index: Segments, batch: str, terms: DataFrame, aliases: DataFrame, touched: DataFrame) -> bool:
    """Index the touched terms anew; those that are terms no more go."""
    ids = touched.select("term_id")
    return index.apply(batch, term_rows(terms.join(ids, "term_id", "left_semi"), aliases.join(ids, "term_id", "left_semi")), ids.join(terms, "term_id", "left_anti"))


def index_source(index: Segments, batch: str, sections: DataFrame) -> bool:
    """Index the sections of the sources they belong to in place of what those had; sections without a body but their breadcrumb are left out."""
    said = F.trim(F.regexp_replace("body", r"\s+", " "))
    return index.apply(batch, sections.filter(said != ""), sections)


