"""The engine's calls: each takes plain arguments and returns a dict of at most a page of rows; what can't be done is a status, not an error."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import documents, enrich, fuzzy, index, search, snippets, taxonomy
from corpusloom.operators.segments import TERM_COLUMNS, Segments, term_rows
from corpusloom.plans import guarded
from corpusloom.plans.parser import Parsed, QueryError, parse

SEARCH_MOST, NAMES_MOST, PAGE_MOST = 20, 16, 50
INDEXED = {"sections": ["domain", "slug", "section_title", "section_level", "body"], "readmes": ["domain", "slug", "body"], "terms": TERM_COLUMNS}


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def soft(call):
    """A query that can't be read becomes a result with a status."""

    def run(*args, **kwargs):
        try:
            return call(*args, **kwargs)
        except QueryError as e:
            return {"status": "malformed_query", "error": str(e)}

    run.__name__, run.__doc__ = call.__name__, call.__doc__
    return run


class Engine:
    """tables: sources (kind, id, slug, title, date, domain, collection, abstract, markdown), sections (key, slug, domain, section_title, section_level, body),
    readmes (key, slug, domain, body), members (slug, domain, collection), topics (slug, topic), terms (term_id, domain, term_type, entity_type, canonical_name),
    aliases (term_id, alias, slug), repos (slug, url, paper, status, domain, collection), code_files (repo, path, language, size_bytes, content),
    references (src, ref_number, raw_text, cited, cited_slug), figures (slug, number, label, caption, image, mime).
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], as_of: datetime.date | None = None, indexes: dict[str, Segments] | None = None):
        """indexes: maintained indexes of sections, readmes or terms, read as they stand at each call; surfaces without one are indexed from their tables at their first call."""
        self.spark, self.t, self.as_of = spark, tables, as_of
        self._maintained = indexes or {}
        self._indexes: dict[str, index.Index] = {}

    def _index(self, surface: str) -> index.Index:
        if surface in self._maintained:
            return self._maintained[surface].index()
        if surface not in self._indexes:
            rows, key = (self._term_rows(), "term_id") if surface == "terms" else (self.t[surface], "key")
            self._indexes[surface] = index.build(rows, key, INDEXED[surface], stemmed=surface == "terms")
        return self._indexes[surface]

    def _rows(self, surface: str) -> DataFrame:
        return self._maintained[surface].rows() if surface in self._maintained else self._term_rows() if surface == "terms" else self.t[surface]

    def _term_rows(self) -> DataFrame:
        return term_rows(self.t["terms"], self.t["aliases"])

    def _snippets(self, surface: str, own: Parsed, hits: DataFrame, width: int) -> DataFrame:
        return snippets.snippets(self._index(surface), self._rows(surface), own.node, hits, "body", INDEXED[surface].index("body"), width).drop("snip_start", "n_phrases", "n_spans")

    def _today(self) -> datetime.date:
        return self.as_of or datetime.datetime.now(datetime.UTC).date()

    def _ranked(self, surface: str, own: Parsed, boost: float, since: str | None) -> DataFrame:
        dates = self.t["sources"] if surface == "sections" else self.t["repos"].join(self.t["sources"].select(F.col("slug").alias("paper"), "date"), "paper", "left").select("slug", "date")
        return search.ranked(self._index(surface), self._rows(surface).drop("body"), own, sources=dates, members=self.t["members"], boost=boost if surface == "sections" else 0.0, since=since, as_of=self._today(), keep_undated=surface == "readmes")

    def _with(self, query: str, **given: str | None) -> Parsed:
        own = parse(query)
        for key, value in given.items():
            if value is not None:
                if own.qualifiers.get(key, value) != value:
                    raise QueryError(f"{key}: is given twice")
                own.qualifiers[key] = value
        if own.node is None:
            raise QueryError("no words to search for")
        return own

    def _enriched(self, grouped: DataFrame, surface: str) -> DataFrame:
        """A page's sources with topics, entities, figures and repository; a README's repository stands for its paper."""
        repos = self.t["repos"]
        if surface == "readmes":
            linked = repos.select(F.col("slug").alias("repo_slug"), F.col("paper").alias("key"))
            return enrich.enrich(grouped.join(linked, F.col("slug") == F.col("repo_slug"), "left").drop("repo_slug"), "key", *self._children()).withColumnRenamed("key", "paper")
        return enrich.enrich(grouped.withColumn("key", F.col("slug")), "key", *self._children()).drop("key")

    def _children(self) -> list[DataFrame]:
        by = lambda name, key: self.t[name].withColumn("key", F.col(key))
        return [by("topics", "slug"), by("aliases", "slug"), self.t["terms"], by("figures", "slug"), by("repos", "paper")]

    @soft
    def bm25(self, query: str, scope: str = "sections", domain: str | None = None, collection: str | None = None, limit: int = 15, offset: int = 0, recency_boost: float = 0.2, since: str | None = None, snippet_tokens: int = snippets.WIDE) -> dict:
        """Hits by source of one surface or both, with snippets and totals; bare words that match nothing are joined by OR."""
        own = self._with(query, domain=domain, collection=collection)
        if "kind" in own.qualifiers or own.qualifiers.get("surface") == "taxonomy":
            raise QueryError("bm25 searches sections and readmes")
        surfaces = [own.qualifiers["surface"]] if "surface" in own.qualifiers else ["sections", "readmes"] if scope == "both" else [scope]
        out: dict = {"status": "ok", "query": query, "fallback": None}
        for tried in (own, Parsed(own.fallback, own.qualifiers) if own.fallback else None):
            if tried is None:
                break
            for s in surfaces:
                hits = self._ranked(s, tried, recency_boost, since)
                columns = ["section_title", "section_level"] if s == "sections" else ["domain"]
                paged = self._snippets(s, tried, search.page(hits, "key", limit, offset), snippet_tokens)
                out[s] = _dicts(self._enriched(search.grouped(paged, [*columns, "score", "snippet"]), s).orderBy("best_rank"))
                out[f"{s}_total"] = hits.count()
            if any(out[f"{s}_total"] for s in surfaces):
                out["fallback"] = "OR" if tried is not own else None
                break
        out["has_more"] = any(out[f"{s}_total"] > offset + limit for s in surfaces)
        return out

    @soft
    def search(self, query: str | list[str], domain: str | None = None, limit: int = 5, union: bool = False, recency_boost: float = 0.2, since: str | None = None) -> dict:
        """One query: its buckets. Several (8 at most): each one's, or with union one fused list."""
        if not 1 <= limit <= SEARCH_MOST:
            raise QueryError(f"limit is 1 to {SEARCH_MOST}")
        if isinstance(query, str):
            return self.bm25(query, "both", domain, None, limit, 0, recency_boost, since, snippets.WIDTH) | {"taxonomy": self.lookup(query, domain, limit).get("terms", [])}
        if len(query) > search.QUERIES_MOST:
            raise QueryError(f"at most {search.QUERIES_MOST} queries")
        if not union:
            return {"status": "ok", "queries": [self.search(q, domain, limit, False, recency_boost, since) for q in query]}
        lists = []
        for q, said in enumerate(query):
            own = self._with(said, domain=domain)
            for surface in ("sections", "readmes"):
                paged = search.flattened(search.page(self._ranked(surface, own, recency_boost, since), "key", limit))
                item = [F.lit("section"), "slug", "section_title"] if surface == "sections" else [F.lit("readme"), "slug"]
                lists.append((q, paged.select(F.concat_ws(" / ", *item).alias("item"), "rank")))
        return {"status": "ok", "results": _dicts(search.fuse(lists, min(limit * len(query), search.FUSED_MOST)).orderBy("rank"))}

    @soft
    def lookup(self, query: str, domain: str | None = None, limit: int = 50, offset: int = 0) -> dict:
        """Canonical terms whose name, aliases or kind match by word stems, with aliases and sources."""
        own = self._with(query, domain=domain)
        rows = self._rows("terms")
        if kind := own.qualifiers.get("kind"):
            rows = rows.filter(F.col("term_type") == kind)
        hits = search.ranked(self._index("terms"), rows.withColumn("slug", F.col("canonical_name")), Parsed(own.node, {k: v for k, v in own.qualifiers.items() if k == "domain"}))
        sources = self.t["aliases"].groupBy("term_id").agg(F.sort_array(F.collect_set("slug")).alias("sources"))
        return {"status": "ok", "terms": _dicts(search.page(hits, "term_id", min(limit, PAGE_MOST), offset).drop("slug").join(sources, "term_id", "left").orderBy("rank")), "total": hits.count()}

    def browse(self, which: str, domain: str | None = None, limit: int | None = 1000, offset: int = 0) -> dict:
        """collections, topics, entity_type or aliases with their counts, or needs_review: sources marked so; total and truncated tell what a limit leaves out; None is all of it, on the driver."""
        members = self.t["members"] if domain is None else self.t["members"].filter(F.col("domain") == domain)
        terms = self.t["terms"] if domain is None else self.t["terms"].filter(F.col("domain") == domain)
        views = {
            "collections": lambda: taxonomy.collection_counts(members),
            "topics": lambda: self.t["topics"].groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic"),
            "entity_type": lambda: terms.filter("term_type = 'entity'").groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type"),
            "aliases": lambda: self.t["aliases"].join(terms, "term_id").select("canonical_name", "alias").distinct().orderBy("canonical_name", "alias"),
            "needs_review": lambda: self._to_review(domain),
        }
        if which not in views:
            return {"status": "unknown_view", "which": which}
        rows = views[which]()
        paged, total = rows.offset(offset), rows.count()
        return {"status": "ok", which: _dicts(paged if limit is None else paged.limit(limit)), "total": total, "truncated": limit is not None and total > offset + limit}

    def _to_review(self, domain: str | None) -> DataFrame:
        own = self.t["sources"] if domain is None else self.t["sources"].filter(F.col("domain") == domain)
        return own.filter("needs_review").select("kind", "slug", "title", "domain").orderBy("kind", "slug") if "needs_review" in own.columns else own.limit(0).select("kind", "slug", "title", "domain")

    def overview(self, domain: str | None = None, most: int = 30) -> dict:
        """Domains with their largest collections and how many more there are."""
        own = self.t["sources"] if domain is None else self.t["sources"].filter(F.col("domain") == domain)
        out: dict = {}
        for r in taxonomy.top_collections(own, most).orderBy("domain", "place").collect():
            d = out.setdefault(r["domain"], {"domain": r["domain"], "overflow": r["overflow"], "collections": []})
            d["collections"].append({"name": r["collection"], "n": r["n"]})
        return {"status": "ok", "domains": list(out.values())}

    def collection(self, names: list[str], domain: str | None = None, limit: int = 20) -> dict:
        """Members of up to 16 collections, newest first; names that are none are told."""
        asked = list(dict.fromkeys(names))
        names = asked[:NAMES_MOST]
        own = self.t["sources"].drop("collection", "domain").join(self.t["members"], "slug")
        own = own if domain is None else own.filter(F.col("domain") == domain)
        rows = _dicts(taxonomy.collection_detail(own, names, limit).orderBy("domain", "collection", "place"))
        return {"status": "ok", "members": rows, "missing": [n for n in names if n not in {r["collection"] for r in rows}], "not_asked": asked[NAMES_MOST:]}

    def coverage(self, topic: str, domain: str | None = None, most: int = 5, least: int = 70) -> dict:
        """How much there is on a topic: sources that match on each surface and the best of them, collections of that name, and the likest names of each kind."""
        if not topic.strip():
            raise ValueError("coverage needs a topic")
        topic, out = topic.strip(), {"status": "ok", "topic": topic}
        try:
            node = parse(topic).node
        except QueryError:
            node = None
        for surface in ("sections", "readmes"):
            counted = "sources" if surface == "sections" else "repos"
            if node is None:
                out |= {surface: 0, counted: 0, f"{surface}_top": []}
                continue
            hits = search.ranked(self._index(surface), self._rows(surface).drop("body"), Parsed(node, {"domain": domain} if domain else {}))
            n = hits.agg(F.count("*").alias("hits"), F.countDistinct("slug").alias("sources")).first()
            title = ["section_title"] if surface == "sections" else []
            out |= {surface: n["hits"], counted: n["sources"], f"{surface}_top": _dicts(search.page(hits, "key", most).orderBy("rank").select("slug", *title))}
        here = lambda df: df if domain is None else df.filter(F.col("domain") == domain)
        collections, terms = here(self.t["members"]).select("collection", "domain").distinct(), here(self.t["terms"])
        out["collections_exact"] = _dicts(collections.filter(F.lower("collection") == topic.lower()).orderBy("domain", "collection"))
        names = collections.select(F.lit("collections").alias("bucket"), F.col("collection").alias("name"), F.struct("domain", F.lit("").alias("kind"), F.lit("").alias("of")).alias("id"))
        names = names.union(terms.filter(F.col("term_type").isin("entity", "topic", "collection")).select("term_type", "canonical_name", F.struct("domain", F.coalesce("term_type", F.lit("")), F.lit(""))))
        names = names.union(self.t["aliases"].join(terms, "term_id").select(F.lit("aliases"), "alias", F.struct("domain", F.coalesce("term_type", F.lit("")), "canonical_name")))
        likest = fuzzy.similar_to(self.spark.createDataFrame([(topic,)], "topic string"), names, least, most).orderBy("bucket", "place")
        out["similar"] = [{"bucket": r["bucket"], "name": r["name"], **{k: v for k, v in r["id"].asDict().items() if v}, "ratio": r["similarity"]} for r in likest.collect()]
        return out

    def toc(self, slugs: str | list[str]) -> dict:
        """Level and title of each section."""
        wanted = list(dict.fromkeys([slugs] if isinstance(slugs, str) else slugs))
        rows = documents.sections(self.t["sources"].filter(F.col("slug").isin(wanted)), "slug", "markdown").orderBy("slug", "ord").select("slug", "level", "title").collect()
        own = {s: [{"level": r["level"], "title": r["title"]} for r in rows if r["slug"] == s] for s in wanted}
        return {"status": "ok", "sections": {s: v for s, v in own.items() if v}, "missing": [s for s, v in own.items() if not v]}

    def read(self, slug: str, section: list[str] | None = None) -> dict:
        """A source's markdown, or the first section whose path ends with the given titles."""
        own = self.t["sources"].filter(F.col("slug") == slug).select("slug", "markdown")
        row = own.first()
        if row is None:
            return {"status": "not_found", "slug": slug}
        if section is None:
            return {"status": "ok", "slug": slug, "content": row["markdown"]}
        try:
            found = documents.read_section(own, "slug", "markdown", section).first()
        except ValueError as e:
            return {"status": "malformed_section_query", "error": str(e)}
        if found is None:
            return {"status": "section_not_found", "titles": [s["title"] for s in self.toc(slug)["sections"].get(slug, []) if s["level"] <= 2]}
        return {"status": "ok", "slug": slug, "title": found["title"], "content": found["content"]}

    def figure(self, slug: str, n: str | int) -> dict:
        """A figure by its number, else by its label."""
        own = self.t["figures"].filter(F.col("slug") == slug).filter((F.col("number").cast("string") == str(n)) | (F.col("label") == str(n)))
        row = own.orderBy(F.when(F.col("number").cast("string") == str(n), 0).otherwise(1), "number").first()
        return {"status": "ok", **row.asDict()} if row else {"status": "not_found", "slug": slug, "n": n}

    def citations(self, slug: str, direction: str = "outbound", limit: int = 50, offset: int = 0) -> dict:
        """What a source cites, by whether it is held, or which sources cite it, newest first."""
        refs = self.t["references"]
        if direction == "outbound":
            rows = _dicts(refs.filter(F.col("src") == slug).orderBy("ref_number").limit(501))
            kinds = {"resolved": [], "missing": [], "unresolvable": []}
            for r in rows[:500]:
                kinds["resolved" if r["cited_slug"] else "missing" if r["cited"] else "unresolvable"].append(r)
            return {"status": "ok", **kinds, "truncated": len(rows) > 500}
        if direction != "inbound" or not slug or self.t["repos"].filter(F.col("slug") == slug).count():
            return {"status": "unsupported_direction", "direction": direction}
        own = refs.filter(F.col("cited_slug") == slug).select(F.col("src").alias("slug")).distinct().join(self.t["sources"].select("slug", "title", "date"), "slug")
        return {"status": "ok", "total": own.count(), "citing": _dicts(own.orderBy(F.desc_nulls_last("date"), "slug").offset(offset).limit(limit))}

    def repo(self, slug: str) -> dict:
        """A repository with its topics and the paper it is linked to."""
        row = self.t["repos"].filter(F.col("slug") == slug).first()
        if row is None:
            return {"status": "not_found", "repo": slug}
        topics = [r["topic"] for r in self.t["topics"].filter(F.col("slug") == slug).select("topic").distinct().orderBy("topic").collect()]
        paper = self.t["sources"].filter(F.col("slug") == row["paper"]).select("slug", "title").first() if row["paper"] else None
        return {"status": "ok", "repo": row.asDict(), "topics": topics, "paper": paper.asDict() if paper else None}

    def repo_tree(self, repo: str, limit: int | None = 1000, offset: int = 0) -> dict:
        """A repository's files by path, a page of them, with totals of all; truncated tells that there are more."""
        row = self.t["repos"].filter(F.col("slug") == repo).first()
        if row is None:
            return {"status": "no_repo", "repo": repo}
        if str(row["status"] or "").startswith("failed") or row["status"] == "orphaned":
            return {"status": "failed_repo", "repo": repo, "repo_status": row["status"]}
        own = self.t["code_files"].filter(F.col("repo") == repo)
        total = own.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")).first()
        paged = own.orderBy("path").select("path", "language", "size_bytes").offset(offset)
        return {"status": "ok", "paper_name": row["paper"], "files": total["files"], "bytes": total["bytes"] or 0, "paths": _dicts(paged if limit is None else paged.limit(limit)), "truncated": limit is not None and total["files"] > offset + limit}

    def read_code(self, repo: str, path: str, lines: tuple[int, int] | None = None) -> dict:
        """A file, or lines first to last of it, counted from 1."""
        if lines and not 1 <= lines[0] <= lines[1]:
            return {"status": "malformed_lines", "lines": lines}
        row = self.t["code_files"].filter((F.col("repo") == repo) & (F.col("path") == path)).first()
        if row is None:
            return {"status": "file_not_found", "path": path}
        own = row["content"].splitlines(keepends=True)
        return {"status": "ok", "path": path, "content": "".join(own[lines[0] - 1 : lines[1]] if lines else own), "n_lines": len(own)}

    def tables(self) -> dict:
        return {"status": "ok", "tables": [{"name": n, "columns": df.columns} for n, df in sorted(self.t.items())]}

    def query(self, sql: str) -> dict:
        """One reading statement over the tables."""
        for name, df in self.t.items():
            df.createOrReplaceTempView(name)
        return guarded.run(self.spark, sql)
