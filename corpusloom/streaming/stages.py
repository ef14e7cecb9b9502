"""Ingest as stages over a store: each takes all sources whose status lets it run and commits what it made together with their new statuses.

So a stopped run goes on where it was, a stage that ran does nothing when it runs again, and a source that fails keeps its error and its status while the others go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.operators import documents
from corpusloom.operators.segments import Segments
from corpusloom.sources import shared
from corpusloom.sources.store import Store
from corpusloom.streaming import ingest

TIERS = ("html", "mirror", "latex", "pdf")
#: Fixed value: what an error page says in place of a paper.
FATAL = "Conversion to HTML had a Fatal error"
#: Texts stand apart from statuses, so a stage writes the small table and its own.
TABLES = {
    "papers": "id long, slug string, title string, published string, raw_id string, tier string, domain string, collection string, needs_review boolean, status string, error string, ingested_at string, n_terms long, n_sections long",
    "bodies": "id long, tier string, body string",
    "markdown": "id long, markdown string",
    "members": "id long, domain string, collection string, is_primary boolean",
    "mentions": "id long, short string, long string",
    "sections": "id long, ord long, level int, title string, breadcrumb string, body string",
}
CHILDREN = ("bodies", "markdown", "members", "mentions", "sections")
SECTION_COLUMNS = ["title", "breadcrumb", "body"]


def create(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """A store with empty tables."""
    store = Store(spark, path, buckets)
    store.create({name: (spark.createDataFrame([], schema), ["id"]) for name, schema in TABLES.items()})
    return store


def section_index(spark: SparkSession, path: str, buckets: int = 64) -> Segments:
    return Segments(spark, path, "key", "slug", SECTION_COLUMNS, buckets=buckets)


def valid(tier: Column, code: Column, content_type: Column, url: Column, body: Column) -> Column:
    """Whether an answer holds a paper: status 200 and some text; web pages must be HTML, under /html/ after redirects, and no error page."""
    page = F.lower(content_type).startswith("text/html") & url.contains("/html/") & ~F.lower(body).contains(FATAL.lower())
    return F.coalesce((code == 200) & (F.trim(body) != "") & (~tier.isin("html", "mirror") | page), F.lit(False))


def first_valid(fetched: DataFrame) -> DataFrame:
    """id, tier, body: of each source's answers (id, tier, code, content_type, url, body) the first that is valid, in the order of TIERS. Bodies are not sorted."""
    place = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    good = fetched.filter((place > 0) & valid(*(F.col(c) for c in ("tier", "code", "content_type", "url", "body"))))
    best = good.groupBy("id").agg(F.min_by("tier", place).alias("tier"))
    return good.join(best, ["id", "tier"]).dropDuplicates(["id"]).select("id", "tier", "body")


def slugs(new: DataFrame, held: DataFrame) -> DataFrame:
    """id, slug, taken: slugs of new papers (id, title, published, raw_id); one that is held or that a smaller id makes as well ends in the last five signs of the plain id.

    taken: that one is in use, too.
    """
    plain = ids.plain_id(F.col("raw_id"))
    own = new.select("id", ids.paper_slug(F.col("title"), F.col("published"), plain).alias("base"), F.right(plain, F.lit(5)).alias("tail"))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("id")))
    used = held.select(F.col("slug").alias("base")).filter("base is not null").distinct().withColumn("used", F.lit(True))
    own = own.join(used, "base", "left").withColumn("slug", F.when(F.col("used").isNull() & (F.col("n") == 1), F.col("base")).otherwise(F.concat_ws("_", "base", "tail")))
    again = Window.partitionBy("slug").orderBy("id")
    return own.withColumn("place", F.row_number().over(again)).join(used.select(F.col("base").alias("slug"), F.col("used").alias("held")), "slug", "left").select("id", "slug", ((F.col("place") > 1) | F.col("held").isNotNull()).alias("taken"))


class Ingest:
    """convert: body -> struct<markdown, error>. as_of: what ingested_at says of new sources."""

    def __init__(self, store: Store, index: Segments, convert: Callable[[Column], Column], as_of: str):
        self.store, self.index, self.convert, self.as_of, self.spark = store, index, convert, as_of, store.spark

    def _made(self, rows: DataFrame, what: str) -> DataFrame:
        """What a stage made, worked out once: written to the shared folder and read back."""
        path = shared.fresh_path(self.spark, what)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _waiting(self, target: str) -> DataFrame:
        """Sources right before a stage."""
        status = F.col("status")
        return self.store.read("papers").filter(ingest.can_run(status, F.lit(target), ingest.PAPER) & status.isNotNull() & (status != target))

    def _commit(self, papers: DataFrame, **made: DataFrame) -> None:
        """Statuses and a stage's own rows at once; a source's earlier rows of that table are replaced."""
        changes = {name: self.store.merged(name, rows, ["id"]) for name, rows in made.items()}
        self.store.replace(changes | {"papers": self.store.merged("papers", papers, ["id"])})

    def fetch(self, requests: DataFrame, fetched: DataFrame) -> None:
        """requests: id, title, published, raw_id. Those that are held already are left as they are; forced ones have no status and keep slug and first date.

        A source without a body names its slug though it is in use; one with a body must have its own, so a forced one that had none is named again.
        """
        held = self.store.read("papers")
        new = requests.filter("id is not null").dropDuplicates(["id"]).join(held.filter("status is not null"), "id", "left_anti")
        kept = held.filter("status is null").select("id", F.col("slug").alias("old"), F.col("ingested_at").alias("since"))
        # of sources with one slug it belongs to one with a body, else to the smallest id
        owner = held.filter("slug is not null").groupBy(F.col("slug").alias("old")).agg(F.min(F.struct(F.col("tier").isNull().alias("bare"), "id")).alias("m")).select("old", F.col("m.id").alias("id"))
        kept = kept.join(owner.withColumn("own", F.lit(True)), ["id", "old"], "left").withColumn("old", F.when(F.col("own"), F.col("old"))).drop("own")
        named = slugs(new.join(kept.filter("old is not null"), "id", "left_anti"), held)
        bodies = self._made(first_valid(fetched.join(new.select("id"), "id", "left_semi")), "bodies")
        got = new.join(bodies.select("id", "tier"), "id", "left").join(kept, "id", "left").join(named, "id", "left")
        found = F.col("tier").isNotNull()
        rows = got.select(
            "id", F.coalesce("old", F.when(~F.col("taken") | ~found, F.col("slug"))).alias("slug"), "title", "published", "raw_id", "tier", *(F.lit(None).cast("string").alias(c) for c in ("domain", "collection")),
            (~found | F.coalesce("taken", F.lit(False))).alias("needs_review"), F.when(found & ~F.coalesce("taken", F.lit(False)), "fetched").otherwise("failed_html").alias("status"),
            F.when(~found, "no tier has a usable body").when(F.col("taken"), F.concat(F.lit("slug in use: "), F.col("slug"))).alias("error"), F.coalesce("since", F.lit(self.as_of)).alias("ingested_at"), F.lit(0).cast("long").alias("n_terms"), F.lit(0).cast("long").alias("n_sections"),
        )
        self._commit(self._made(rows, "fetched"), bodies=bodies)

    def convert_bodies(self) -> None:
        """A body that fails keeps its status and gets an error; markdown that is too short ends the source and asks for review."""
        rows = self._waiting("converted").join(self.store.read("bodies").select("id", "body"), "id").withColumn("made", self.convert(F.col("body")))
        made = self._made(rows.withColumns({"markdown": F.col("made.markdown"), "error": F.col("made.error")}).drop("made", "body"), "converted")
        good = F.col("error").isNull()
        useful = ingest.useful(F.col("markdown"))
        papers = made.withColumn("status", F.when(~good, F.col("status")).when(useful, "converted").otherwise("failed_parse")).withColumn("needs_review", F.col("needs_review") | ~good | ~useful).drop("markdown")
        self._commit(papers, markdown=made.filter(good & useful).select("id", "markdown"))

    def classify(self, decisions: DataFrame) -> None:
        """decisions: id, domain, collection, is_primary, needs_review, some for each source that was classified; the others wait."""
        waiting = self._waiting("classified").drop("domain", "collection")
        own = self._made(decisions.join(waiting.select("id"), "id", "left_semi").select("id", "domain", "collection", "is_primary", "needs_review").distinct(), "decisions")
        first = own.filter("is_primary").groupBy("id").agg(F.min(F.struct("domain", "collection")).alias("d"), F.max("needs_review").alias("review"))
        papers = waiting.join(first, "id").withColumns({"domain": F.col("d.domain"), "collection": F.col("d.collection"), "needs_review": F.col("needs_review") | F.col("review"), "status": F.lit("classified"), "error": F.lit(None).cast("string")}).drop("d", "review")
        papers = self._made(papers, "classified")
        self._commit(papers, members=own.join(papers.select("id"), "id", "left_semi").drop("needs_review"))

    def extract(self) -> None:
        """Acronyms with their long forms; sources without any are extracted as well."""
        waiting = self._waiting("extracted")
        pairs = waiting.select("id").join(self.store.read("markdown"), "id").select("id", F.explode(documents.acronyms(F.col("markdown"))).alias("p")).select("id", "p.short", "p.long")
        made = self._made(pairs, "mentions")
        n = made.groupBy("id").agg(F.count("*").alias("found"))
        papers = waiting.join(n, "id", "left").withColumns({"n_terms": F.coalesce("found", F.lit(0).cast("long")), "status": F.lit("extracted")}).drop("found")
        self._commit(self._made(papers, "extracted"), mentions=made)

    def index_sections(self) -> None:
        """Sections of the markdown to the table and the search index. The index is changed first, under the store's version as the batch's name, so a crash in between repeats without harm."""
        waiting = self._waiting("indexed")
        own = documents.sections(waiting.select("id").join(self.store.read("markdown"), "id"), "id", "markdown")
        bare = F.trim(F.regexp_replace(F.expr("substring(body, length(breadcrumb) + 3)"), r"\s+", " "))
        made = self._made(own.filter(bare != "").select("id", "ord", "level", "title", "breadcrumb", "body"), "sections")
        papers = self._made(waiting.join(made.groupBy("id").agg(F.count("*").alias("found")), "id", "left").withColumns({"n_sections": F.coalesce("found", F.lit(0).cast("long")), "status": F.lit("indexed")}).drop("found"), "indexed")
        if not papers.isEmpty():
            self.index.apply(f"store-{self.store.snapshot()['version']}", made.join(papers.select("id", "slug"), "id").withColumn("key", F.concat_ws("/", "slug", F.format_string("%06d", "ord"))), papers.select("slug"))
        self._commit(papers, sections=made)

    def force(self, wanted: DataFrame) -> int:
        """Take the sources (id) back to before their fetch in one commit: what hangs on them goes, slug and first date stay. How many."""
        papers = self._made(self.store.read("papers").join(wanted.select("id").distinct(), "id", "left_semi"), "forced")
        if not (n := papers.count()):
            return 0
        keep = {"id", "slug", "title", "published", "raw_id", "ingested_at"}
        reset = papers.select(*((F.col(f.name) if f.name in keep else F.lit(None).cast(f.dataType).alias(f.name)) for f in papers.schema))
        if self.index.manifest().segments:
            self.index.apply(f"force-{self.store.snapshot()['version']}", self.index.rows().limit(0), papers.select("slug"))
        self.store.replace({name: self.store.without(name, papers.select("id")) for name in CHILDREN} | {"papers": self.store.merged("papers", reset, ["id"])})
        return n

    def run(self, requests: DataFrame, fetched: DataFrame, decisions: DataFrame, stop_after: str | None = None) -> DataFrame:
        """All stages in order, or up to one; the summary."""
        steps = {"fetched": lambda: self.fetch(requests, fetched), "converted": self.convert_bodies, "classified": lambda: self.classify(decisions), "extracted": self.extract, "indexed": self.index_sections}
        for stage, step in steps.items():
            step()
            if stage == stop_after:
                break
        return self.summary()

    def summary(self) -> DataFrame:
        """A row for each source: where it stands and what there is of it."""
        return self.store.read("papers").select("id", "slug", "title", "status", "tier", "error", "needs_review", "domain", "collection", "n_terms", "n_sections", "ingested_at")

    def totals(self) -> DataFrame:
        """Counts by status: sources, those to review, their terms and sections."""
        return self.store.read("papers").groupBy("status").agg(F.count("*").alias("sources"), F.sum(F.col("needs_review").cast("int")).alias("to_review"), F.sum("n_terms").alias("terms"), F.sum("n_sections").alias("sections"))
