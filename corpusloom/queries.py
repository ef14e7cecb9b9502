"""Registered queries of the retrieval engine, each beside the SQL that gives the same rows."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import files, ids, text
from corpusloom.operators import books, cascade, classify, documents, enrich, entities, fuzzy, graph, html, index, mutate, resolve, search, segments, snippets, taxonomy
from corpusloom.plans import guarded
from corpusloom.plans.parser import parse, phrases
from corpusloom.sources import corpus, formats, shared, store
from corpusloom.sources.derived import derived, derived_sql
from corpusloom.streaming import ingest, stages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = datetime.date(2026, 1, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- search

SECTIONS = r"""rows_ AS (SELECT doc_id * 1000000 + i - 1 AS key, 'doc_' || doc_id AS slug, lang AS domain, 'line ' || (i - 1) AS section_title, 1 + (i - 1) % 3 AS section_level, body
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS body, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(body) <> '')"""
READMES = "rows_ AS (SELECT item_id AS key, 'gh-lab-' || item_id AS slug, (['rag', 'vision', 'agents'])[item_id % 3 + 1] AS domain, text AS body FROM benchmark)"
SOURCES = "src AS (SELECT 'doc_' || doc_id AS slug, CAST(DATE '2020-01-01' + CAST(doc_id % 2000 AS INTEGER) AS DATE) AS date, lang AS domain, source AS collection FROM documents)"


def bm25_sql(rows: str, columns: list[str], said: str, truth: str) -> str:
    """CTEs up to scored(key, score): matches of the query's phrases in DuckDB, by self-joins of the postings."""
    wanted = list(dict.fromkeys(phrases(parse(said).node)))

    def holds(node) -> str:
        if isinstance(node, index.Phrase):
            return f"(coalesce(f{wanted.index(node)}, 0) > 0)"
        sign = {index.And: "AND", index.Or: "OR", index.Not: "AND NOT"}[type(node)]
        return f"({holds(node.left)} {sign} {holds(node.right)})"

    def gain(node) -> str:
        if isinstance(node, index.Phrase):
            return f"coalesce(p{wanted.index(node)}, 0)"
        return f"CASE WHEN {holds(node)} THEN {gain(node.left)} + {gain(node.right)} ELSE 0 END"

    toks = " UNION ALL ".join(f"SELECT key, {i} AS col, regexp_extract_all(strip_accents(lower(CAST({c} AS VARCHAR))), '[\\p{{L}}\\p{{N}}]+') AS t FROM rows_" for i, c in enumerate(columns))
    parts, ctes = [], []
    for k, p in enumerate(wanted):
        fits = lambda a, i, p=p: f"starts_with({a}.term, '{p.tokens[i]}')" if p.prefix and i == len(p.tokens) - 1 else f"{a}.term = '{p.tokens[i]}'"
        joins = " ".join(f"JOIN post a{i} ON a{i}.key = a0.key AND a{i}.col = a0.col AND a{i}.pos = a0.pos + {i} AND {fits(f'a{i}', i)}" for i in range(1, len(p.tokens)))
        parts.append(f"SELECT a0.key, {k} AS k, count(*) AS f FROM post a0 {joins} WHERE {fits('a0', 0)} GROUP BY a0.key")
        ctes.append(f"max(CASE WHEN k = {k} THEN f END) AS f{k}, max(CASE WHEN k = {k} THEN idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) END) AS p{k}")
    return f"""{rows}, toks AS ({toks}),
post AS (SELECT key, col, unnest(t) AS term, unnest(range(len(t))) AS pos FROM toks),
lens AS (SELECT key, sum(len(t)) AS len FROM toks GROUP BY key),
corpus AS (SELECT count(*) AS total, sum(len) / count(*) AS mean FROM lens),
found AS ({' UNION ALL '.join(parts)}),
idf AS (SELECT k, greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) AS idf FROM (SELECT k, count(*) AS n FROM found GROUP BY k), corpus),
flagged AS (SELECT found.key, {', '.join(ctes)} FROM found JOIN idf USING (k) JOIN lens USING (key), corpus GROUP BY found.key),
scored AS (SELECT key, round(-({gain(parse(said).node)}), 9) AS score FROM flagged WHERE {truth})"""


TOP = "SELECT slug, key, CAST(row_number() OVER (ORDER BY score, key) AS INTEGER) AS rank, round(score, 6) AS score FROM {source} ORDER BY rank LIMIT {n}"


def _sections(spark, sf):
    own = corpus.saved_index(spark, sf, "sections")
    return own.rows(), own.index()


def _hits(paged: DataFrame) -> DataFrame:
    return paged.select("slug", "key", "rank", F.round("score", 6).alias("score"))


COLS = corpus.SECTION_COLUMNS


def _bm25(name: str, said: str, truth: str, limit: int = 15) -> None:
    sql = f"WITH {bm25_sql(SECTIONS, COLS, said, truth)}, hits AS (SELECT * FROM scored JOIN rows_ USING (key)) {TOP.format(source='hits', n=limit)}"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows, own = _sections(spark, sf)
        return _hits(search.page(search.ranked(own, rows, said), "key", limit))

    run.__name__ = name
    query(sql)(run)


_bm25("bm25_and", "the ering", "f0 > 0 AND f1 > 0")
_bm25("bm25_boolean", "die OR le NOT la", "coalesce(f0, 0) > 0 OR (coalesce(f1, 0) > 0 AND NOT coalesce(f2, 0) > 0)", 30)
_bm25("bm25_phrase", '"of the"', "f0 > 0")
_bm25("bm25_prefix", "ering* and", "f0 > 0 AND f1 > 0")
_bm25("bm25_metadata_columns", "line-2 de", "f0 > 0 AND f1 > 0")


@query(f"""WITH {bm25_sql(SECTIONS, COLS, 'the of', 'f0 > 0 AND f1 > 0')}, {SOURCES},
top AS (SELECT slug, key, section_title, row_number() OVER (ORDER BY score, key) AS rank FROM scored JOIN rows_ USING (key) WHERE domain = 'en' ORDER BY score, key LIMIT 15)
SELECT slug, count(*) AS hit_count, CAST(min(rank) AS INTEGER) AS best_rank, string_agg(section_title, '|' ORDER BY rank) AS titles FROM top GROUP BY slug""")
def bm25_grouped(spark, sf):
    rows, own = _sections(spark, sf)
    hits = search.grouped(search.page(search.ranked(own, rows, "the of domain:en"), "key", 15), ["section_title"])
    return hits.select("slug", "hit_count", "best_rank", F.array_join(F.transform("hits", lambda h: h["section_title"]), "|").alias("titles"))


@query(f"""WITH {bm25_sql(SECTIONS, COLS, 'the and', 'f0 > 0 AND f1 > 0')}, {SOURCES},
hits AS (SELECT rows_.slug, key, round(score * (1 + 0.2 * coalesce(exp(-date_diff('day', date, DATE '2026-01-01') / 730.0), 0)), 9) AS score
  FROM scored JOIN rows_ USING (key) LEFT JOIN src USING (slug) WHERE date >= DATE '2022-01-01' AND collection = 'src0') {TOP.format(source='hits', n=15)}""")
def bm25_recency_since_collection(spark, sf):
    rows, own = _sections(spark, sf)
    sources = corpus.sources(spark, sf)
    hits = search.ranked(own, rows, "the and collection:src0", sources=sources, members=sources, boost=0.2, since="2022", as_of=AS_OF)
    return _hits(search.page(hits, "key", 15))


@query(f"WITH {bm25_sql(READMES, ['domain', 'slug', 'body'], 'was OR with', 'coalesce(f0, 0) > 0 OR coalesce(f1, 0) > 0')}, hits AS (SELECT * FROM scored JOIN rows_ USING (key)) {TOP.format(source='hits', n=20)}")
def bm25_readmes(spark, sf):
    own = corpus.saved_index(spark, sf, "readmes")
    return _hits(search.page(search.ranked(own.index(), own.rows(), "was OR with"), "key", 20))


@query(f"""WITH {bm25_sql(SECTIONS, COLS, 'zzzzqq OR thatt OR ering', 'coalesce(f0, 0) > 0 OR coalesce(f1, 0) > 0 OR coalesce(f2, 0) > 0')}, hits AS (SELECT * FROM scored JOIN rows_ USING (key)) {TOP.format(source='hits', n=10)}""")
def bm25_or_fallback(spark, sf):
    rows, own = _sections(spark, sf)
    found, _ = search.with_fallback(lambda q: search.ranked(own, rows, q), "zzzzqq thatt ering")
    return _hits(search.page(found, "key", 10))


def snippet_sql(scored: str, said: str, hits: str, column: int, width: int) -> str:
    """From bm25_sql's CTEs: the hits with the best window of a column and its text."""
    wanted = list(dict.fromkeys(phrases(parse(said).node)))
    places = []
    for k, p in enumerate(wanted):
        fits = lambda a, i, p=p: f"starts_with({a}.term, '{p.tokens[i]}')" if p.prefix and i == len(p.tokens) - 1 else f"{a}.term = '{p.tokens[i]}'"
        joins = " ".join(f"JOIN post a{i} ON a{i}.key = a0.key AND a{i}.col = a0.col AND a{i}.pos = a0.pos + {i} AND {fits(f'a{i}', i)}" for i in range(1, len(p.tokens)))
        places.append(f"SELECT a0.key, {k} AS k, a0.pos AS start, a0.pos + {len(p.tokens)} AS stop FROM post a0 {joins} WHERE a0.col = {column} AND {fits('a0', 0)}")
    token = "[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{Mn}]*"
    inside = lambda edge, at: f"len(list_filter(spans, lambda b: b.start < {at} AND {at} < b.stop)) = 0 AND len(list_filter(spans, lambda b: b.{edge} = {at})) > 0"
    return f"""WITH {scored}, top AS ({hits}),
place AS ({' UNION ALL '.join(places)}),
held AS (SELECT a.key, a.start, b.k, b.start AS s, b.stop AS e FROM (SELECT DISTINCT key, start FROM place WHERE key IN (SELECT key FROM top)) a
  JOIN place b ON b.key = a.key AND b.start BETWEEN a.start AND a.start + {width - 1} AND (b.stop <= a.start + {width} OR b.start = a.start)),
win AS (SELECT key, start, count(DISTINCT k) AS n_phrases, list_sort(list(DISTINCT {{'start': s, 'stop': e}})) AS spans FROM held GROUP BY key, start),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_phrases DESC, len(spans) DESC, start) AS place FROM win) WHERE place = 1),
texts AS (SELECT top.slug, top.rank, best.* EXCLUDE (start), greatest(0, least(start, len(regexp_extract_all(body, '{token}')) - {width})) AS start, regexp_extract_all(body, '{token}') AS w, string_split_regex(body, '{token}') AS sep FROM top JOIN rows_ USING (key) JOIN best USING (key)),
ends AS (SELECT *, least(len(w), start + {width}) AS stop FROM texts)
SELECT slug, key, rank, CAST(start AS INTEGER) AS snip_start, CAST(n_phrases AS INTEGER) AS n_phrases, CAST(len(spans) AS INTEGER) AS n_spans,
  CASE WHEN start > 0 THEN '…' ELSE '' END || array_to_string(list_transform(range(start, stop), lambda i:
    CASE WHEN {inside('start', 'i')} THEN '[' ELSE '' END || w[i + 1] || CASE WHEN {inside('stop', '(i + 1)')} THEN ']' ELSE '' END || CASE WHEN i + 1 < stop THEN sep[i + 2] ELSE '' END), '')
  || CASE WHEN stop < len(w) THEN '…' ELSE '' END AS snippet FROM ends"""


TOP_KEYS = "SELECT slug, key, CAST(row_number() OVER (ORDER BY score, key) AS INTEGER) AS rank FROM scored JOIN rows_ USING (key) ORDER BY score, key LIMIT {n}"


def _snippets(name: str, said: str, truth: str, limit: int, width: int) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows, own = _sections(spark, sf)
        node = parse(said).node
        hits = search.page(search.ranked(own, rows.drop("body"), said), "key", limit).select("slug", "key", "rank")
        return snippets.snippets(own, rows, node, hits, "body", 4, width)

    run.__name__ = name
    query(snippet_sql(bm25_sql(SECTIONS, COLS, said, truth), said, TOP_KEYS.format(n=limit), 4, width))(run)


_snippets("search_snippets", "the ering and", "f0 > 0 AND f1 > 0 AND f2 > 0", 20, 64)
_snippets("search_snippets_phrases", '"of the" OR die OR ering*', "coalesce(f0, 0) > 0 OR coalesce(f1, 0) > 0 OR coalesce(f2, 0) > 0", 50, 16)


REVISED = """documents AS (SELECT d.doc_id, d.lang, d.source, CASE WHEN l.low THEN d.text || chr(10) || 'revised ering of the ' || d.lang ELSE d.text END AS text FROM raw_ d
  LEFT JOIN (SELECT doc_id, bool_or(toxic = 1) AS toxic, bool_or(quality = 0) AS low FROM labels GROUP BY doc_id) l USING (doc_id) WHERE NOT coalesce(l.toxic, false)
  UNION ALL SELECT doc_id + 1000000, lang, source, text FROM raw_ JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id))"""


def _edited(spark: SparkSession, sf: str):
    """An index of all documents after three batches: toxic ones deleted, low-quality ones revised, good ones added once more under new ids; each batch is sent twice."""
    docs, labels = corpus.table(spark, sf, "documents"), corpus.table(spark, sf, "labels")
    own = segments.Segments(spark, shared.fresh_path(spark, "index-edited"), "key", "slug", corpus.SECTION_COLUMNS)
    own.rebuild(corpus.sections_of(docs))
    marked = lambda condition: docs.join(labels.filter(condition).select("doc_id").distinct(), "doc_id", "left_semi")
    low = marked("quality = 0").withColumn("text", F.concat("text", F.lit("\nrevised ering of the "), "lang"))
    toxic = marked("toxic = 1").select(F.concat(F.lit("doc_"), "doc_id").alias("slug"))
    more = marked("quality = 1").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    for _ in range(2):
        own.apply("revised", corpus.sections_of(low))
        own.apply("toxic", corpus.sections_of(docs.limit(0)), toxic)
        own.apply("added", corpus.sections_of(more))
    return own


def _edited_sql(said: str, truth: str, n: int) -> str:
    """The documents' CTE comes first; a view of the same name is what it reads, so the raw table goes by another."""
    own = bm25_sql(SECTIONS, COLS, said, truth).replace("FROM documents)", "FROM edited)")
    return f"WITH raw_ AS (SELECT * FROM documents), {REVISED.replace('documents AS', 'edited AS', 1)}, {own}, hits AS (SELECT * FROM scored JOIN rows_ USING (key)) {TOP.format(source='hits', n=n)}"


@query(_edited_sql("ering OR revised", "coalesce(f0, 0) > 0 OR coalesce(f1, 0) > 0", 200))
def bm25_after_edits(spark, sf):
    own = _edited(spark, sf)
    return _hits(search.page(search.ranked(own.index(), own.rows(), "ering OR revised"), "key", 200))


@query(_edited_sql('"of the" AND ering', "f0 > 0 AND f1 > 0", 100))
def bm25_after_merge(spark, sf):
    own = _edited(spark, sf)
    own.merge(1)
    own.vacuum()
    return _hits(search.page(search.ranked(own.index(), own.rows(), '"of the" AND ering'), "key", 100))


TERM_ROWS = """alias AS (SELECT p_partkey AS term_id, string_agg(DISTINCT a, ' ' ORDER BY a) AS aliases FROM (SELECT p_partkey, p_type || CASE WHEN p_size > 25 THEN ' large' ELSE ' small' END AS a FROM part WHERE p_size > 10) GROUP BY p_partkey),
rows_ AS (SELECT p_partkey AS key, p_brand AS slug, p_brand AS domain, split_part(p_type, ' ', 1) AS term_type, NULL AS entity_type, CASE WHEN p_size > 40 THEN p_name || ' renamed' ELSE p_name END AS canonical_name, coalesce(aliases, '') AS aliases
  FROM part LEFT JOIN alias ON term_id = p_partkey)"""


@query(f"""WITH {bm25_sql(TERM_ROWS, segments.TERM_COLUMNS, 'renamed OR large', 'coalesce(f0, 0) > 0 OR coalesce(f1, 0) > 0')}
SELECT key AS term_id, CAST(row_number() OVER (ORDER BY score, key) AS INTEGER) AS rank, round(score, 6) AS score FROM scored ORDER BY rank LIMIT 50""")
def term_index_scoped_rebuild(spark, sf):
    """Terms are indexed without aliases; one source then gives aliases to those of size over 10, and a run flags those over 40, which it has renamed."""
    part = corpus.table(spark, sf, "part")
    kind = F.substring_index("p_type", " ", 1)
    named = part.select(F.col("p_partkey").alias("term_id"), F.col("p_brand").alias("domain"), kind.alias("term_type"), F.lit(None).cast("string").alias("entity_type"), "p_name", "p_size", "p_type")
    old = named.withColumnRenamed("p_name", "canonical_name")
    new = named.withColumn("canonical_name", F.when(F.col("p_size") > 40, F.concat("p_name", F.lit(" renamed"))).otherwise(F.col("p_name")))
    aliases = named.filter("p_size > 10").select("term_id", F.concat("p_type", F.when(F.col("p_size") > 25, " large").otherwise(" small")).alias("alias"), F.lit("paper").alias("slug"))
    own = segments.Segments(spark, shared.fresh_path(spark, "index-terms"), "term_id", "term_id", segments.TERM_COLUMNS)
    own.rebuild(segments.term_rows(old, aliases.limit(0)))
    segments.rebuild_terms(own, "paper", new, aliases, segments.touched_terms(aliases, named.filter("p_size > 40"), "paper"))
    hits = search.ranked(own.index(), own.rows().withColumn("slug", F.col("domain")), "renamed OR large")
    return search.page(hits, "term_id", 50).select("term_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {bm25_sql(SECTIONS, COLS, 'the ering', 'f0 > 0 AND f1 > 0')}, top AS (SELECT slug, key, CAST(floor(key / 1000000) AS BIGINT) AS id, CAST(row_number() OVER (ORDER BY score, key) AS INTEGER) AS rank FROM scored JOIN rows_ USING (key) ORDER BY rank LIMIT 20),
named AS (SELECT DISTINCT id, p_partkey, p_type, p_name FROM top JOIN lineitem ON l_orderkey = id JOIN part ON p_partkey = l_partkey WHERE p_size > 10),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_type, p_name, p_partkey) AS place FROM named)
SELECT slug, key, rank, coalesce((SELECT string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = id), '') AS topics,
  coalesce((SELECT string_agg(p_type || ':' || p_name, '|' ORDER BY place) FROM placed WHERE placed.id = top.id AND place <= 5), '') AS entities,
  (SELECT count(*) FROM events WHERE user_id = id) AS n_figures, (SELECT arg_min(event_type, event_id) FROM events WHERE user_id = id) AS first_caption, (SELECT min('gh-' || s_name) FROM supplier WHERE s_suppkey = id) AS repo FROM top""")
def search_enriched(spark, sf):
    """A page of hits with what hangs on their documents: orders as topics, parts of order lines as entities, events as figures, suppliers as repositories."""
    rows, own = _sections(spark, sf)
    hits = search.page(search.ranked(own, rows.drop("body"), "the ering"), "key", 20).select("slug", "key", F.floor(F.col("key") / 1_000_000).cast("long").alias("id"), "rank")
    of = lambda name, *columns: corpus.table(spark, sf, name).select(*columns)
    found = enrich.enrich(
        hits, "id", of("orders", F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("topic")), of("lineitem", F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("term_id")),
        of("part", F.col("p_partkey").alias("term_id"), F.when(F.col("p_size") > 10, "entity").otherwise("topic").alias("term_type"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("canonical_name")),
        of("events", F.col("user_id").alias("id"), F.col("event_id").alias("number"), F.col("event_type").alias("caption")), of("supplier", F.col("s_suppkey").alias("id"), F.concat(F.lit("gh-"), "s_name").alias("slug"), F.lit("u").alias("url")),
    )
    joined = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["name"])), "|")
    return found.select("slug", "key", "rank", F.array_join("topics", "|").alias("topics"), joined.alias("entities"), F.col("figures.count").alias("n_figures"), "figures.first_caption", F.col("repo.slug").alias("repo"))


@query("""WITH m AS (SELECT DISTINCT 'paper' AS kind, o_custkey AS id FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT 'repo', p_partkey FROM part WHERE p_size > 30),
t AS (SELECT 'paper' AS kind, c_custkey AS id, c_mktsegment AS topic FROM customer UNION ALL SELECT 'repo', p_partkey, p_type FROM part UNION ALL SELECT 'post', s_suppkey, 'x' FROM supplier)
SELECT topic, count(*) AS n, CAST(sum(CASE WHEN kind = 'paper' THEN 1 ELSE 0 END) AS BIGINT) AS paper_n, CAST(sum(CASE WHEN kind = 'post' THEN 1 ELSE 0 END) AS BIGINT) AS post_n, CAST(sum(CASE WHEN kind = 'repo' THEN 1 ELSE 0 END) AS BIGINT) AS repo_n FROM t SEMI JOIN m USING (kind, id) GROUP BY topic""")
def topics_in_collection(spark, sf):
    orders, part, customer, supplier = (corpus.table(spark, sf, n) for n in ("orders", "part", "customer", "supplier"))
    one = lambda df, kind, key, what, name: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), what.alias(name))
    urgent = F.when(F.col("o_orderpriority").startswith("1"), "c").otherwise("other")
    members = one(orders, "paper", "o_custkey", urgent, "collection").union(one(part, "repo", "p_partkey", F.when(F.col("p_size") > 30, "c"), "collection"))
    topics = one(customer, "paper", "c_custkey", F.col("c_mktsegment"), "topic").union(one(part, "repo", "p_partkey", F.col("p_type"), "topic")).union(one(supplier, "post", "s_suppkey", F.lit("x"), "topic"))
    return enrich.topics_in(topics, members, "c")


def _rrf_sql() -> str:
    """Lists of 20 hits for each query and surface; sections are ranked by their document's best hit, then by their own; every place of a list counts."""

    def part(q: int, surface: str, said: str, truth: str) -> str:
        rows, cols = (SECTIONS, COLS) if surface == "section" else (READMES, ["domain", "slug", "body"])
        item = "'section / ' || slug || ' / ' || section_title" if surface == "section" else "'readme / ' || slug"
        return f"""SELECT {item} AS item, {q} AS q, row_number() OVER (ORDER BY first, place) AS rank FROM (SELECT *, min(place) OVER (PARTITION BY slug) AS first FROM (
  WITH {bm25_sql(rows, cols, said, truth)} SELECT scored.key, rows_.*, row_number() OVER (ORDER BY score, scored.key) AS place FROM scored JOIN rows_ USING (key) ORDER BY place LIMIT 20))"""

    asked = [("the ering", "f0 > 0 AND f1 > 0"), ("and of", "f0 > 0 AND f1 > 0"), ("was", "f0 > 0")]
    lists = " UNION ALL ".join(part(q, surface, *a) for q, a in enumerate(asked) for surface in ("section", "readme"))
    return f"""WITH lists AS ({lists}),
fused AS (SELECT item, sum(1.0 / (60 + rank)) AS fused, string_agg(DISTINCT CAST(q AS VARCHAR), ',' ORDER BY CAST(q AS VARCHAR)) AS matched_queries FROM lists GROUP BY item)
SELECT item, round(fused, 9) AS fused, matched_queries, CAST(row_number() OVER (ORDER BY round(fused, 12) DESC, item) AS INTEGER) AS rank FROM fused ORDER BY rank LIMIT 50"""


@query(_rrf_sql())
def search_multi_rrf(spark, sf):
    lists = []
    for q, said in enumerate(("the ering", "and of", "was")):
        for surface in ("sections", "readmes"):
            own = corpus.saved_index(spark, sf, surface)
            paged = search.flattened(search.page(search.ranked(own.index(), own.rows(), said), "key", 20))
            item = F.concat_ws(" / ", F.lit("section"), "slug", "section_title") if surface == "sections" else F.concat_ws(" / ", F.lit("readme"), "slug")
            lists.append((q, paged.select(item.alias("item"), "rank")))
    return search.fuse(lists).withColumn("fused", F.round("fused", 9))


@query("""SELECT p_brand AS domain, count(*) AS n, count(DISTINCT split_part(p_type, ' ', 1)) AS kinds FROM part
WHERE list_contains(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), '7') OR p_name LIKE '%1%' GROUP BY p_brand""")
def lookup_terms(spark, sf):
    own = corpus.terms(spark, sf).filter(F.array_contains(text.tokens(F.col("canonical_name")), "7") | F.col("canonical_name").contains("1"))
    return own.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("term_type").alias("kinds"))


@query(f"""WITH {bm25_sql(SECTIONS, COLS, 'the thing', 'f0 > 0 AND f1 > 0')}, {SOURCES}
SELECT domain, count(*) AS sections, count(DISTINCT slug) AS sources FROM scored JOIN rows_ USING (key) GROUP BY domain""")
def coverage_counts(spark, sf):
    rows, own = _sections(spark, sf)
    return search.ranked(own, rows, "the thing").groupBy("domain").agg(F.count("*").alias("sections"), F.countDistinct("slug").alias("sources"))


# ---- taxonomy views


@query("SELECT collection, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, collection) AS INTEGER) AS place FROM (SELECT DISTINCT o_orderstatus, o_custkey, o_orderpriority AS collection FROM orders) GROUP BY collection")
def browse_collections(spark, sf):
    return taxonomy.collection_counts(corpus.memberships(spark, sf))


@query("""SELECT topic, count(*) AS n, count(*) FILTER (kind = 'a') AS n_a, count(*) FILTER (kind = 'b') AS n_b
FROM (SELECT DISTINCT event_type AS topic, user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS kind FROM events) GROUP BY topic""")
def browse_topics(spark, sf):
    own = corpus.table(spark, sf, "events").select(F.col("event_type").alias("topic"), F.col("user_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("kind"))
    return taxonomy.topic_counts(own, ["a", "b"])


@query("""SELECT lang AS domain, NULL AS collection, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY lang
UNION ALL SELECT lang, source, count(*) FROM documents GROUP BY lang, source""")
def overview(spark, sf):
    own = corpus.sources(spark, sf)
    return taxonomy.overview(own.withColumn("attached", F.col("id") % 5 == 0))


@query("""SELECT * FROM (SELECT lang AS domain, source AS collection, count(*) AS n, CAST(row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS INTEGER) AS place,
greatest(count(*) OVER (PARTITION BY lang) - 5, 0) AS overflow FROM documents GROUP BY lang, source) WHERE place <= 5""")
def top_collections(spark, sf):
    return taxonomy.top_collections(corpus.sources(spark, sf), 5)


@query(f"""WITH {SOURCES} SELECT * REPLACE (CAST(date AS VARCHAR) AS date), total > 7 AS truncated FROM (SELECT domain, collection, slug, date, CAST(row_number() OVER (PARTITION BY domain, collection ORDER BY date DESC NULLS LAST, slug) AS INTEGER) AS place,
count(*) OVER (PARTITION BY domain, collection) AS total FROM src WHERE collection IN ('src1', 'src2')) WHERE place <= 7""")
def collection_detail(spark, sf):
    return taxonomy.collection_detail(corpus.sources(spark, sf), ["src1", "src2"], 7).withColumn("date", F.col("date").cast("string"))


@query("SELECT 'nowhere' AS name")
def collection_missing(spark, sf):
    return taxonomy.missing_names(corpus.sources(spark, sf), spark.createDataFrame([("src1",), ("nowhere",)], "name string"))


@query("""SELECT p_brand, p_name, CAST(place AS INTEGER) AS place, total FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_name, p_partkey) AS place, count(*) OVER (PARTITION BY p_brand) AS total FROM part) WHERE place <= 5""")
def entities_preview(spark, sf):
    return taxonomy.preview(corpus.table(spark, sf, "part"), "p_brand", ["p_type", "p_name", "p_partkey"]).select("p_brand", "p_name", "place", "total")


@query("SELECT l_orderkey AS repo, count(*) AS files, round(sum(l_quantity), 2) AS bytes FROM lineitem GROUP BY l_orderkey")
def repo_tree(spark, sf):
    return corpus.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("repo")).agg(F.count("*").alias("files"), F.round(F.sum("l_quantity"), 2).alias("bytes"))


@query("SELECT conv_id, turn, text FROM conversations WHERE turn BETWEEN 1 AND 2")
def read_code_lines(spark, sf):
    own = corpus.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("lines"))
    return own.select("conv_id", F.explode(F.slice("lines", 2, 2)).alias("l")).filter("l.turn between 1 and 2").select("conv_id", "l.turn", "l.text")


@query("""SELECT slug, kind FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p) AS n FROM (
SELECT 'doc_' || doc_id AS slug, 'paper' AS kind, 0 AS p FROM documents UNION ALL SELECT 'doc_' || (page_id * 7), 'post', 1 FROM pages)) WHERE n = 1""")
def slug_lookup(spark, sf):
    papers = corpus.sources(spark, sf).select("slug", "kind", F.lit(0).alias("p"))
    posts = corpus.table(spark, sf, "pages").select(F.concat(F.lit("doc_"), F.col("page_id") * 7).alias("slug"), F.lit("post").alias("kind"), F.lit(1).alias("p"))
    return papers.unionByName(posts).groupBy("slug").agg(F.min(F.struct("p", "kind")).alias("m")).select("slug", F.col("m.kind").alias("kind"))


# ---- citations

EDGES = "edges AS (SELECT l_orderkey AS src, l_linenumber AS ref_number, CASE WHEN l_partkey % 10 <> 0 THEN l_partkey END AS cited FROM lineitem), known AS (SELECT p_partkey AS cited, p_partkey + 1000000 AS cited_id FROM part WHERE p_partkey % 3 <> 0), done AS (SELECT edges.*, cited_id FROM edges LEFT JOIN known USING (cited))"


def _resolved(spark, sf):
    known = corpus.table(spark, sf, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("cited"), (F.col("p_partkey") + 1_000_000).alias("cited_id"))
    return graph.resolve(corpus.references(spark, sf), known)


@query(f"WITH {EDGES} SELECT src, ref_number, cited, cited_id FROM done")
def citations_resolved(spark, sf):
    return _resolved(spark, sf).select("src", "ref_number", "cited", "cited_id")


@query(f"""WITH {EDGES}, placed AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ref_number NULLS LAST, cited NULLS LAST, cited_id NULLS LAST) AS place FROM done)
SELECT src, count(*) FILTER (place <= 3 AND cited_id IS NOT NULL) AS resolved, count(*) FILTER (place <= 3 AND cited_id IS NULL AND cited IS NOT NULL) AS missing,
count(*) FILTER (place <= 3 AND cited IS NULL) AS unresolvable, count(*) > 3 AS truncated FROM placed GROUP BY src""")
def citations_outbound(spark, sf):
    return graph.outbound(_resolved(spark, sf), most=3)


@query(f"""WITH {EDGES}, citing AS (SELECT DISTINCT cited_id, src, o_orderdate AS date FROM done JOIN orders ON o_orderkey = src WHERE cited_id IS NOT NULL)
SELECT cited_id, src, date, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cited_id ORDER BY date DESC NULLS LAST, src) AS place FROM citing) WHERE place BETWEEN 3 AND 7""")
def citations_inbound(spark, sf):
    citing = corpus.table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_orderdate").alias("date"))
    return graph.inbound(_resolved(spark, sf), citing, limit=5, offset=2)


@query(f"""SELECT src, ref_number, coalesce(nullif(lower(regexp_extract(raw_text, '{ids.MENTION}', 1)), ''), nullif(regexp_extract(raw_text, '{ids.MENTION}', 2), ''), nullif(regexp_extract(raw_text, '{ids.MENTION}', 3), '')) AS cited FROM {derived_sql('lit_refs')}""")
def reference_ids(spark, sf):
    return derived(spark, sf, "lit_refs").select("src", "ref_number", ids.mentioned_id(F.col("raw_text")).alias("cited"))


# ---- terms

NORM = r"regexp_replace(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' (?:model|method|framework|dataset|benchmark|system|approach)$', '')"


@query(f"SELECT canonical_name, {NORM.format(x='canonical_name')} AS norm FROM {derived_sql('lit_terms')} UNION ALL SELECT p_name, {NORM.format(x='p_name')} FROM part")
def normalize_terms(spark, sf):
    own = derived(spark, sf, "lit_terms").select("canonical_name").union(corpus.table(spark, sf, "part").select("p_name"))
    return own.select("canonical_name", text.normalize_term(F.col("canonical_name")).alias("norm"))


@query(f"""WITH t AS (SELECT *, {NORM.format(x='canonical_name')} AS norm FROM {derived_sql('lit_terms')}), a AS (SELECT t.term_id, domain, term_type, {NORM.format(x='alias')} AS norm FROM {derived_sql('lit_aliases')} JOIN t USING (term_id)),
n AS (SELECT *, {NORM.format(x='raw')} AS norm FROM {derived_sql('lit_names')}),
r AS (SELECT raw, n.domain, n.term_type, (SELECT min(term_id) FROM t WHERE t.domain = n.domain AND t.term_type = n.term_type AND canonical_name = raw) AS t1,
coalesce((SELECT min(term_id) FROM t WHERE t.domain = n.domain AND t.term_type = n.term_type AND t.norm = n.norm), (SELECT min(term_id) FROM a WHERE a.domain = n.domain AND a.term_type = n.term_type AND a.norm = n.norm)) AS t2 FROM n)
SELECT raw, domain, term_type, coalesce(t1, t2) AS term_id, CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 END AS tier FROM r""")
def resolve_exact_and_normal(spark, sf):
    return resolve.exact_and_normal(derived(spark, sf, "lit_names").drop("ord"), derived(spark, sf, "lit_terms"), derived(spark, sf, "lit_aliases"))


def _common_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two strings of at most 60 letters, by bit-parallel rows."""
    letter = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] = c THEN (1::BIGINT << (i - 1)::BIGINT) ELSE 0 END))::BIGINT"
    full = f"((1::BIGINT << length({a})) - 1)"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, list_transform(string_split({b}, ''), lambda c: {letter})), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})))"


RAW = "SELECT left(c_name, length(c_name) - 1) AS raw, c_mktsegment AS domain, 'entity' AS term_type FROM customer WHERE c_custkey % 50 = 0"


def _raw_names(spark, sf):
    """Names of every fiftieth customer without their last letter, and all customers as terms."""
    held = corpus.table(spark, sf, "customer").select(F.col("c_custkey").alias("term_id"), F.col("c_name").alias("canonical_name"), F.col("c_mktsegment").alias("domain"), F.lit("entity").alias("term_type"))
    return held.filter("term_id % 50 = 0").select(F.expr("left(canonical_name, length(canonical_name) - 1)").alias("raw"), "domain", "term_type"), held


@query(f"""SELECT DISTINCT raw, n.domain, n.term_type, c_custkey AS term_id FROM ({RAW}) n JOIN customer ON n.domain = c_mktsegment
WHERE lower(left(raw, 1)) = lower(left(c_name, 1)) OR abs(length(raw) - length(c_name)) <= 3""")
def fuzzy_candidates(spark, sf):
    return resolve.candidates(*_raw_names(spark, sf))


@query(f"""WITH n AS (SELECT *, {NORM.format(x='raw')} AS x FROM ({RAW})), t AS (SELECT *, {NORM.format(x='c_name')} AS y FROM customer),
scored AS (SELECT raw, n.domain, n.term_type, c_custkey AS term_id, c_name, 200.0 * {_common_sql('x', 'y')} / (length(x) + length(y)) AS ratio FROM n JOIN t ON n.domain = t.c_mktsegment
  WHERE lower(left(raw, 1)) = lower(left(c_name, 1)) OR abs(length(raw) - length(c_name)) <= 3)
SELECT raw, domain, term_type, term_id, ratio FROM (SELECT *, row_number() OVER (PARTITION BY raw, domain ORDER BY ratio DESC, length(c_name), term_id) AS place FROM scored WHERE ratio >= 85) WHERE place = 1""")
def fuzzy_matches(spark, sf):
    return resolve.fuzzy(*_raw_names(spark, sf))


NAMES = """SELECT 'entity' AS bucket, p_name AS name, p_partkey AS id FROM part UNION ALL SELECT 'topic', p_brand || ' ' || p_type, p_partkey FROM part
UNION ALL SELECT 'collection', c_mktsegment, c_custkey FROM customer UNION ALL SELECT 'alias', c_name, c_custkey FROM customer UNION ALL SELECT 'alias', s_name, s_suppkey FROM supplier"""


@query(f"""WITH topics AS (SELECT DISTINCT name AS topic FROM ({NAMES}) WHERE id % 50 = 0), names AS (SELECT DISTINCT name FROM ({NAMES})),
pairs AS (SELECT topic, name, lower(topic) AS a, lower(name) AS b FROM topics JOIN names ON 200 * least(length(topic), length(name)) >= 70 * (length(topic) + length(name))),
scored AS (SELECT topic, name, CAST(floor(200.0 * {_common_sql('a', 'b')} / (length(a) + length(b)) + 1e-9) AS INTEGER) AS similarity FROM pairs),
ranked AS (SELECT topic, bucket, CAST(row_number() OVER (PARTITION BY topic, bucket ORDER BY similarity DESC, name, id) AS INTEGER) AS place, name, id, similarity FROM scored JOIN ({NAMES}) USING (name) WHERE similarity >= 70)
SELECT * FROM ranked WHERE place <= 5""")
def fuzzy_names(spark, sf):
    """The names of every fiftieth part, customer and supplier as topics, against all names, five of each bucket."""
    part, customer, supplier = (corpus.table(spark, sf, n) for n in ("part", "customer", "supplier"))
    one = lambda df, bucket, name, key: df.select(F.lit(bucket).alias("bucket"), name.alias("name"), F.col(key).alias("id"))
    held = one(part, "entity", F.col("p_name"), "p_partkey").union(one(part, "topic", F.concat_ws(" ", "p_brand", "p_type"), "p_partkey"))
    held = held.union(one(customer, "collection", F.col("c_mktsegment"), "c_custkey")).union(one(customer, "alias", F.col("c_name"), "c_custkey")).union(one(supplier, "alias", F.col("s_name"), "s_suppkey"))
    return fuzzy.similar_to(held.filter("id % 50 = 0").select(F.col("name").alias("topic")), held)


@query("""WITH q AS (SELECT vec_id AS query_id, label, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT query_id, vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))), 9) AS cosine FROM q JOIN embeddings USING (label) WHERE query_id <> vec_id)
SELECT query_id, id, round(cosine, 6) AS cosine, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS place FROM d) WHERE place <= 10""")
def nearest_in_scope(spark, sf):
    own = corpus.table(spark, sf, "embeddings")
    q = own.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"), F.col("embedding").alias("q"))
    return resolve.neighbours(q, own.select(F.col("vec_id").alias("id"), F.col("label").alias("scope"), F.col("embedding").alias("v"))).withColumn("cosine", F.round("cosine", 6))


@query("""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 9) AS cosine FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id <> b.vec_id)
SELECT query_id, id, round(cosine, 6) AS cosine, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS place FROM d) WHERE place <= 10""")
def nearest_in_scope_all(spark, sf):
    own = corpus.table(spark, sf, "embeddings")
    q = own.select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"), F.col("embedding").alias("q"))
    return resolve.neighbours(q, own.select(F.col("vec_id").alias("id"), F.col("label").alias("scope"), F.col("embedding").alias("v"))).withColumn("cosine", F.round("cosine", 6))


@query("""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 9) AS cosine FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id <> b.vec_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS place FROM d) WHERE place <= 10),
o AS (SELECT *, CASE WHEN place = 1 THEN cosine >= 0.3 ELSE cosine >= 0.88 * lag(cosine) OVER (PARTITION BY query_id ORDER BY place) END AS ok FROM k),
s AS (SELECT *, min(CAST(ok AS INTEGER)) OVER (PARTITION BY query_id ORDER BY place) AS held FROM o)
SELECT query_id, count(*) AS n, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM s WHERE held = 1 GROUP BY query_id""")
def gradient_survivors(spark, sf):
    own = corpus.table(spark, sf, "embeddings")
    q = own.select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"), F.col("embedding").alias("q"))
    return resolve.survivors(resolve.neighbours(q, own.select(F.col("vec_id").alias("id"), F.col("label").alias("scope"), F.col("embedding").alias("v"))), near=0.3)


@query(f"SELECT doc, start, arg_max(norm, (score, -ord)) AS norm, arg_max(label, (score, -ord)) AS label, max(score) AS score FROM {derived_sql('lit_spans')} GROUP BY doc, start HAVING max(score) >= CASE arg_max(label, (score, -ord)) WHEN 'model' THEN 0.8 ELSE 0.45 END")
def span_labels(spark, sf):
    best = resolve.best_label(derived(spark, sf, "lit_spans"), ["doc", "start"])
    return resolve.over_threshold(best, {"model": 0.8}).select("doc", "start", "norm", "label", "score")


@query("""SELECT norm, label, votes, score FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY votes DESC, first) AS n FROM
(SELECT l_partkey AS norm, l_returnflag AS label, count(*) AS votes, max(l_discount) AS score, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2)) WHERE n = 1""")
def label_vote(spark, sf):
    own = corpus.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("norm"), F.col("l_returnflag").alias("label"), F.col("l_discount").alias("score"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    return resolve.vote(own)


GAZETTEER = """words AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
names AS (SELECT array_to_string(w[1:1 + item_id % 3], ' ') AS phrase, 1 + item_id % 3 AS n, (['model', 'dataset', 'method'])[item_id % 3 + 1] AS label, 0.5 + item_id % 5 / 10.0 AS score FROM words
  UNION ALL SELECT array_to_string(w[2:3], ' '), 2, (['metric', 'model'])[item_id % 2 + 1], 0.4 + item_id % 4 / 10.0 FROM words),
gaz AS (SELECT phrase, n, label, max(score) AS score FROM names WHERE phrase <> '' GROUP BY ALL)"""


def _gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """Beginnings of the benchmark's items, which documents repeat: one to three first words, and the second and third."""
    own = corpus.table(spark, sf, "benchmark").select("item_id", text.tokens(F.col("text")).alias("w"))
    k = F.col("item_id")
    one = own.select(F.array_join(F.slice("w", F.lit(1), (1 + k % 3).cast("int")), " ").alias("name"), F.element_at(F.array(*map(F.lit, ("model", "dataset", "method"))), (k % 3 + 1).cast("int")).alias("label"), (0.5 + k % 5 / 10.0).alias("score"))
    return one.union(own.select(F.array_join(F.slice("w", 2, 2), " "), F.element_at(F.array(F.lit("metric"), F.lit("model")), (k % 2 + 1).cast("int")), 0.4 + k % 4 / 10.0))


SPANS = f"""{GAZETTEER}, toks AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
pos AS (SELECT doc_id, unnest(w) AS first, unnest(range(len(w))) AS start FROM toks),
found AS (SELECT DISTINCT doc_id, start, n, phrase FROM pos JOIN (SELECT DISTINCT phrase, n, split_part(phrase, ' ', 1) AS first FROM gaz) USING (first) JOIN toks USING (doc_id) WHERE array_to_string(w[start + 1:start + n], ' ') = phrase),
spans AS (SELECT * FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.doc_id = a.doc_id AND b.start < a.start + a.n AND a.start < b.start + b.n AND (b.n > a.n OR (b.n = a.n AND b.start < a.start))))"""


@query(f"WITH {SPANS} SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS n, phrase FROM spans")
def entity_spans(spark, sf):
    return entities.longest(entities.matches(corpus.table(spark, sf, "documents"), "doc_id", "text", _gazetteer(spark, sf)), "doc_id").select("doc_id", "start", "n", "phrase")


@query(f"""WITH {SPANS}, best AS (SELECT doc_id, start, phrase, arg_max(label, (score, -r)) AS label, max(score) AS score FROM (SELECT spans.*, label, score, row_number() OVER (PARTITION BY doc_id, start ORDER BY label) AS r FROM spans JOIN gaz USING (phrase)) GROUP BY doc_id, start, phrase),
kept AS (SELECT doc_id, {NORM.format(x='phrase')} AS norm, label FROM best WHERE score >= CASE label WHEN 'model' THEN 0.6 ELSE 0.45 END AND length(phrase) >= 3 AND lower(phrase) NOT IN ({', '.join(repr(x) for x in documents.NO_ENTITY)}) AND NOT regexp_matches(phrase, '^[0-9]'))
SELECT doc_id, norm, count(*) AS n FROM kept GROUP BY doc_id, norm""")
def entity_chain(spark, sf):
    """Entities of all documents and how often they stand there; labels decide which stand, and the SQL leaves out which of them the vote names."""
    return entities.extract(corpus.table(spark, sf, "documents"), "doc_id", "text", _gazetteer(spark, sf), {"model": 0.6}).select("doc_id", "norm", "n")


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ord) AS n FROM {derived_sql('lit_evidence')}),
f AS (SELECT term, CAST(0 AS BIGINT) AS n, '' AS label, CAST('-inf' AS DOUBLE) AS score FROM (SELECT DISTINCT term FROM e) UNION ALL
SELECT f.term, e.n, CASE WHEN e.label <> '' AND e.label <> f.label AND e.score > f.score THEN e.label ELSE f.label END, CASE WHEN e.label <> '' AND e.label <> f.label AND e.score > f.score THEN e.score ELSE f.score END FROM f JOIN e ON e.term = f.term AND e.n = f.n + 1)
SELECT term, arg_max(label, n) AS label, arg_max(score, n) AS score FROM f GROUP BY term""")
def entity_type_fold(spark, sf):
    return resolve.settle_type(derived(spark, sf, "lit_evidence"))


@query(f"""SELECT name, trim(name) = '' OR regexp_matches(trim(name), '[\\n\\r\\t]') OR regexp_full_match(trim(name), '\\d+') OR regexp_matches(trim(name), '[-/:,@#]$') OR regexp_matches(trim(name), '^[+-]') OR length(trim(name)) > 100
OR regexp_matches(trim(name), '^(?:Table|Figure|Fig\\.?|Appendix|Section|Chapter|Eq\\.?|Equation)\\s+\\S+$') OR regexp_matches(trim(name), '^[+\\-]?\\d[\\d.,]*(?:\\s*[a-zA-Z%]+)*$')
OR lower(trim(name)) IN ({', '.join(repr(x) for x in documents.NO_ENTITY)}) OR {NORM.format(x='trim(name)')} IN ('dataset', 'method', 'model', 'metric') OR (length(trim(name)) < 3 AND upper(trim(name)) NOT IN {documents.SHORT_ENTITY}) AS garbage FROM {derived_sql('lit_entities')}""")
def entity_garbage(spark, sf):
    return derived(spark, sf, "lit_entities").select("name", documents.is_garbage(F.col("name"), ["dataset", "method", "model", "metric"]).alias("garbage"))


@query()
def resolver_tiers(spark, sf):
    names = derived(spark, sf, "lit_names").withColumn("vector", F.lit(None).cast("array<float>"))
    return resolve.resolve(names, derived(spark, sf, "lit_terms").withColumn("vector", F.lit(None).cast("array<float>")), derived(spark, sf, "lit_aliases"))


@query("SELECT p_brand AS domain, string_agg(DISTINCT split_part(p_type, ' ', 1), ' ' ORDER BY split_part(p_type, ' ', 1)) AS aliases FROM part GROUP BY p_brand")
def alias_concat(spark, sf):
    return corpus.terms(spark, sf).groupBy("domain").agg(F.array_join(F.sort_array(F.collect_set("term_type")), " ").alias("aliases"))


# ---- ids, slugs, files, headings

REPO_PARTS = r"^(?i:https?)://(?i:www\.)?([^/?#]+)/+([^/?#]+)/+([^/?#]+?)(?:\.git)?/*(?:[?#].*)?$"


@query(f"""WITH b AS (SELECT raw, regexp_replace(regexp_replace(trim(raw), '^https?://arxiv\\.org/(?:abs|pdf)/', ''), '\\.pdf$', '') AS p, regexp_replace(regexp_replace(regexp_replace(trim(raw), '^(?:https?://)?(?:www\\.)?aclanthology\\.org/', ''), '/+$', ''), '\\.(?:pdf|xml|bib)$', '') AS a,
regexp_replace(trim(raw), '[.,);:!?\\]}}>]+$', '') AS u FROM {derived_sql('lit_ids')})
SELECT raw, CASE WHEN regexp_full_match(p, '(?:\\d{{4}}\\.\\d{{4,5}}|[a-z\\-]+/\\d{{7}})(?:v\\d+)?') THEN p END AS preprint, CASE WHEN regexp_full_match(a, '(?:\\d{{4}}\\.[a-z][a-z0-9]*(?:-[a-z0-9]+)*\\.\\d+|[A-Z]\\d{{2}}-\\d{{4}})') THEN a END AS anthology,
CASE WHEN lower(regexp_extract(u, '{REPO_PARTS}', 1)) IN ('github.com', 'gitlab.com', 'bitbucket.org') THEN 'https://' || lower(regexp_extract(u, '{REPO_PARTS}', 1)) || '/' || regexp_extract(u, '{REPO_PARTS}', 2) || '/' || regexp_extract(u, '{REPO_PARTS}', 3) END AS repo FROM b""")
def identifiers(spark, sf):
    raw = F.col("raw")
    return derived(spark, sf, "lit_ids").select("raw", ids.preprint_id(raw).alias("preprint"), ids.anthology_id(raw).alias("anthology"), ids.repo_url(raw).alias("repo"))


def _id_segments(at: str) -> str:
    """How many path segments behind the `at`-th are a preprint id, its version aside."""
    bare = lambda x: f"regexp_replace({x}, 'v\\d+$', '')"
    return f"CASE WHEN regexp_full_match({bare(f'parts[{at} + 1]')}, '\\d{{4}}\\.\\d{{4,5}}') THEN 1 WHEN regexp_full_match(parts[{at} + 1] || '/' || {bare(f'parts[{at} + 2]')}, '[a-z\\-]+/\\d{{7}}') THEN 2 ELSE 0 END"


_HOST_SHORT = " ".join(f"WHEN '{h}' THEN '{x}'" for h, x in ids.HOSTS.items())
_PLAIN = lambda i: f"nullif(regexp_replace(regexp_replace(lower(regexp_extract(u, '{REPO_PARTS}', {i})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"


@query(f"""WITH b AS (SELECT raw, rtrim(trim(raw), '{ids.TRAILING}') AS u, string_split(raw, '/') AS parts FROM {derived_sql('lit_ids')}), c AS (SELECT *, coalesce(list_position(parts, 'html'), 0) AS h FROM b),
d AS (SELECT *, {_id_segments('h')} AS n, {_id_segments('4')} AS m, CASE lower(regexp_extract(u, '{REPO_PARTS}', 1)) {_HOST_SHORT} END AS short FROM c)
SELECT raw, concat_ws('-', short, CASE WHEN short IS NOT NULL THEN {_PLAIN(2)} END, CASE WHEN short IS NOT NULL THEN {_PLAIN(3)} END) AS slug,
  CASE WHEN h > 0 AND n > 0 AND len(parts) > h + 2 * n AND array_to_string(parts[h + 1:h + n], '/') = regexp_replace(array_to_string(parts[h + n + 1:h + 2 * n], '/'), 'v\\d+$', '') THEN array_to_string(parts[:h] || parts[h + n + 1:], '/') ELSE raw END AS figure,
  CASE WHEN array_to_string(parts[:4], '/') = 'https://arxiv.org/html' AND m > 0 AND array_to_string(parts[m + 5:], '/') <> '' THEN 'https://ar5iv.labs.arxiv.org/html/' || regexp_replace(array_to_string(parts[5:m + 4], '/'), 'v\\d+$', '') || '/assets/' || array_to_string(parts[m + 5:], '/') END AS mirror FROM d""")
def identifier_urls(spark, sf):
    raw = F.col("raw")
    return derived(spark, sf, "lit_ids").select("raw", ids.repo_slug(ids.repo_url(raw)).alias("slug"), ids.figure_url(raw).alias("figure"), ids.figure_mirror(raw).alias("mirror"))


@query(f"""WITH w AS (SELECT *, lower(strip_accents(title)) AS f FROM {derived_sql('lit_titles')}),
v AS (SELECT *, CASE WHEN contains(title, ':') THEN regexp_replace(lower(strip_accents(split_part(title, ':', 1))), '[^a-z0-9]+', '', 'g')
ELSE array_to_string(list_filter(string_split_regex(regexp_replace(f, '[^a-z0-9\\s]+', ' ', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN {ids.STOP_WORDS})[1:3], '_') END AS base, regexp_replace(lower(regexp_replace(id, 'v\\d+$', '')), '[^a-z0-9]+', '', 'g') AS own FROM w)
SELECT title, coalesce(nullif(base, ''), own) || '_' || date[1:4] AS slug FROM v""")
def paper_slugs(spark, sf):
    return derived(spark, sf, "lit_titles").select("title", ids.paper_slug(F.col("title"), F.col("date"), ids.plain_id(F.col("id"))).alias("slug"))


@query(f"SELECT name, regexp_replace(left(regexp_replace(regexp_replace(lower(name), '[\\s/]+', '_', 'g'), '[^a-z0-9_-]', '', 'g'), 64), '^[_-]+|[_-]+$', '', 'g') AS domain FROM {derived_sql('lit_domains')}")
def domain_names(spark, sf):
    return derived(spark, sf, "lit_domains").select("name", text.sanitize_domain(F.col("name")).alias("domain"))


def _unmarked(t: str) -> str:
    """A title without the bold or italic marks that stand at both of its ends."""
    cut = lambda mark: f"WHEN starts_with({t}, '{mark}') AND ends_with({t}, '{mark}') AND length({t}) >= {2 * len(mark)} THEN substr({t}, {len(mark) + 1}, length({t}) - {2 * len(mark)})"
    return f"CASE {' '.join(map(cut, ('**', '__', '*', '_')))} ELSE {t} END"


@query(f"""SELECT title, lower(trim(regexp_replace(regexp_replace(trim(regexp_replace({_unmarked('trim(title)')}, '^\\d+(?:\\.\\d+)*\\.?\\s+', '')), ':+$', ''), '\\s+', ' ', 'g'))) AS token FROM {derived_sql('lit_headings')}""")
def heading_tokens(spark, sf):
    return derived(spark, sf, "lit_headings").select("title", text.breadcrumb_token(F.col("title")).alias("token"))


_NAME = "list_extract(string_split(path, '/'), -1)"
_EXT = f"lower(regexp_extract({_NAME}, '^.+(\\.[^.]*)$', 1))"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query(f"""SELECT repo, path FROM {derived_sql('lit_files')} WHERE len(list_filter(list_slice(string_split(path, '/'), 1, -2), lambda d: d IN {_LIST(files.SKIP_DIRS)} OR d LIKE '%.egg-info')) = 0
AND {_NAME} NOT IN {_LIST(files.SKIP_NAMES)} AND {_NAME} NOT LIKE 'events.out.tfevents.%' AND {_EXT} NOT IN {_LIST(files.SKIP_EXTS)} AND size <= CASE WHEN {_EXT} IN {_LIST(files.SMALL_EXTS)} THEN 50000 ELSE 1000000 END
AND length(content) - length(replace(content, '�', '')) <= 0.01 * length(content) AND NOT (contains(content, chr(0)) AND strlen(split_part(content, chr(0), 1)) < 8192)
AND NOT ({_EXT} IN ('.js', '.css') AND list_avg(list_transform(string_split(regexp_replace(content, '\\n$', ''), chr(10))[1:100], lambda x: length(x))) > 110)""")
def file_filter(spark, sf):
    return files.kept_files(derived(spark, sf, "lit_files").withColumn("content", F.encode("content", "UTF-8"))).select("repo", "path")


@query(f"SELECT repo, path FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY list_position(['readme.md', 'readme.rst', 'readme.txt', 'readme'], lower(path)), path) AS n FROM {derived_sql('lit_files')} WHERE lower(path) IN ('readme.md', 'readme.rst', 'readme.txt', 'readme')) WHERE n = 1")
def readme_pick(spark, sf):
    return files.readme(derived(spark, sf, "lit_files"), "repo").select("repo", "path")


_LANGUAGE = " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in files.LANGUAGES.items())


@query(f"SELECT repo, path, CASE WHEN lower({_NAME}) = 'dockerfile' THEN 'dockerfile' ELSE CASE {_EXT} {_LANGUAGE} END END AS language FROM {derived_sql('lit_files')}")
def file_languages(spark, sf):
    return derived(spark, sf, "lit_files").select("repo", "path", files.language(F.col("path")).alias("language"))


# ---- documents


@query("WITH l AS (SELECT doc_id, string_split_regex(trim(text), '[ \\t\\n\\r\\f\\v]+') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - 350) / 330.0) AS BIGINT)) + 1)) AS chunk FROM l) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(len(w[chunk * 330 + 1 : chunk * 330 + 350]) AS INTEGER) AS n_tokens, md5(array_to_string(w[chunk * 330 + 1 : chunk * 330 + 350], ' ')) AS digest FROM s")
def overlapping_chunks(spark, sf):
    words = corpus.table(spark, sf, "documents").select("doc_id", documents.split_words(F.col("text")).alias("w"))
    return documents.windows(words, "doc_id", "w").select("doc_id", "chunk", "n_tokens", F.md5("content").alias("digest"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LAST = lambda level, x: f"last_value(CASE WHEN level = {level} THEN {x} END IGNORE NULLS) OVER w"
SECTION_CTES = f"""md AS (SELECT slug, md, string_split(md, chr(10)) AS pieces FROM {derived_sql('lit_markdown')} WHERE md IS NOT NULL),
l AS (SELECT slug, unnest(pieces) AS line, generate_subscripts(pieces, 1) AS i, len(pieces) AS n FROM md),
f AS (SELECT slug, i, line, line || CASE WHEN i < n THEN chr(10) ELSE '' END AS whole, CAST(regexp_matches(line, '^\\s*(```|~~~)') AS INTEGER) AS fence FROM l),
g AS (SELECT *, coalesce(sum(length(whole)) OVER (PARTITION BY slug ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(fence) OVER (PARTITION BY slug ORDER BY i) AS fences, length(line) - length(ltrim(line, '#')) AS marks, trim(ltrim(line, '#'), {_SPACE}) AS said FROM f),
h AS (SELECT *, CASE WHEN fences % 2 = 0 AND fence = 0 AND marks BETWEEN 1 AND 3 AND said <> '' AND contains({_SPACE}, ltrim(line, '#')[1]) THEN marks END AS level FROM g),
o AS (SELECT *, count(level) OVER w AS ord, {_LAST(1, 'i')} AS i1, {_LAST(2, 'i')} AS i2, {_LAST(3, 'i')} AS i3, {_LAST(1, 'said')} AS t1, {_LAST(2, 'said')} AS t2, {_LAST(3, 'said')} AS t3 FROM h WINDOW w AS (PARTITION BY slug ORDER BY i)),
p AS (SELECT *, CASE WHEN level IS NOT NULL THEN list_filter([CASE WHEN i1 IS NOT NULL THEN '# ' || t1 END, CASE WHEN level >= 2 AND i2 > coalesce(i1, 0) THEN '## ' || t2 END, CASE WHEN level = 3 AND i3 > greatest(coalesce(i1, 0), coalesce(i2, 0)) THEN '### ' || t3 END], lambda x: x IS NOT NULL) END AS path FROM o),
s AS (SELECT slug, ord, max(level) AS level, max(CASE WHEN level IS NOT NULL THEN said END) AS title, max(path) AS path, min(start) AS start, coalesce(string_agg(whole, '' ORDER BY i) FILTER (WHERE level IS NULL), '') AS raw FROM p GROUP BY slug, ord),
sections AS (SELECT slug, CAST(ord AS BIGINT) AS ord, CAST(coalesce(level, 1) AS INTEGER) AS level, coalesce(title, 'Abstract') AS title, CASE WHEN ord = 0 THEN '# Abstract' ELSE array_to_string(path, ' > ') END AS breadcrumb, raw, CAST(start AS BIGINT) AS start FROM s WHERE ord > 0 OR trim(raw, {_SPACE}) <> '')"""


@query(f"WITH {SECTION_CTES} SELECT slug, ord, level, title, breadcrumb, breadcrumb || chr(10) || chr(10) || raw AS body, start FROM sections")
def section_split(spark, sf):
    return documents.sections(derived(spark, sf, "lit_markdown"), "slug", "md").drop("norm_path")


@query(f"""WITH {SECTION_CTES}, hits AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ord) AS place FROM sections WHERE lower(trim(regexp_replace({_unmarked('trim(title)')}, ':+$', ''))) = 'setup'),
ends AS (SELECT hits.slug, hits.title, hits.start, (SELECT min(b.start) FROM sections b WHERE b.slug = hits.slug AND b.ord > hits.ord AND b.level <= hits.level) AS stop FROM hits WHERE place = 1)
SELECT ends.slug, title, substr(md, start + 1, coalesce(stop, length(md)) - start) AS content FROM ends JOIN md USING (slug)""")
def section_read(spark, sf):
    return documents.read_section(derived(spark, sf, "lit_markdown"), "slug", "md", ["setup"])


@query(f"""WITH o AS (SELECT *, lag(page) OVER (PARTITION BY book, level ORDER BY ord) AS last FROM {derived_sql('lit_outline')} WHERE page >= 1 AND level <= 2), d AS (SELECT * FROM o WHERE last IS NULL OR last <> page),
c AS (SELECT *, count(*) FILTER (level = 1) OVER (PARTITION BY book) AS n1, count(*) FILTER (level = 2) OVER (PARTITION BY book) AS n2 FROM d),
p AS (SELECT *, CASE WHEN n1 >= 3 THEN 1 WHEN n2 >= 3 THEN 2 WHEN n1 >= 2 THEN 1 END AS pick FROM c), k AS (SELECT *, max(CASE WHEN level = pick AND last > page THEN 1 ELSE 0 END) OVER (PARTITION BY book) AS falls FROM p WHERE pick IS NOT NULL AND level <= pick)
SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY ord) AS INTEGER) AS chapter, trim(title) AS title, page - 1 AS page_start, coalesce((SELECT min(b.page) FROM k b WHERE b.book = k.book AND b.page > k.page) - 1, pages) AS page_end FROM k WHERE falls = 0 AND level = pick""")
def outline_chapters(spark, sf):
    return documents.chapters(derived(spark, sf, "lit_outline"), F.col("pages"))


_BOOKS = "p AS (SELECT source AS book, doc_id AS page, text FROM documents), c AS (SELECT 'src' || item_id % 6 AS book, item_id AS chapter, left(text, 30) AS title, item_id * 13 + 5 AS page_start FROM benchmark)"


def _books(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sources as books with documents as pages, and benchmark items as their chapters."""
    pages = corpus.table(spark, sf, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")
    chapters = corpus.table(spark, sf, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") % 6).alias("book"), F.col("item_id").alias("chapter"), F.left("text", F.lit(30)).alias("title"), (F.col("item_id") * 13 + 5).alias("page_start"))
    return pages, chapters


@query(f"WITH {_BOOKS} SELECT p.book, page, chapter, title FROM p ASOF LEFT JOIN c ON p.book = c.book AND p.page >= c.page_start")
def page_chapters(spark, sf):
    return books.page_chapters(*_books(spark, sf)).select("book", "page", "chapter", "title")


@query(f"""WITH {_BOOKS}, j AS (SELECT p.book, page, text, chapter, title FROM p ASOF JOIN c ON p.book = c.book AND p.page >= c.page_start),
g AS (SELECT book, chapter, count(DISTINCT page) AS n_pages, string_agg(coalesce(text, ''), chr(10) ORDER BY page) AS said FROM j GROUP BY book, chapter)
SELECT book, chapter, n_pages, CASE WHEN chapter BETWEEN 1 AND 99 AND length(trim(said)) >= 200 THEN md5(said) END AS digest, CASE WHEN chapter NOT BETWEEN 1 AND 99 THEN 'no slug for this number' WHEN length(trim(said)) < 200 THEN 'too little text' END AS error FROM g""")
def chapter_sources(spark, sf):
    return books.chapter_sources(*_books(spark, sf)).select("book", "chapter", "n_pages", F.md5("markdown").alias("digest"), "error")


@query()
def acronym_pairs(spark, sf):
    return derived(spark, sf, "lit_acronyms").select("id", F.explode(documents.acronyms(F.col("text"))).alias("p")).select("id", "p.short", "p.long")


@query()
def html_to_markdown(spark, sf):
    own = corpus.table(spark, sf, "pages").select("page_id", html.converted(F.col("html"), F.col("url")).alias("c"))
    return own.select("page_id", F.length("c.markdown").alias("n_chars"), F.size("c.figures").alias("figures"), F.size("c.refs").alias("refs"), F.size(F.regexp_extract_all("c.markdown", F.lit(r"(?m)^(#{1,6}) "), F.lit(1))).alias("headings"))


@query()
def page_metadata(spark, sf):
    own = corpus.table(spark, sf, "pages").select("page_id", html.metadata(F.col("html"), F.col("url")).alias("m"))
    return own.select("page_id", "m.title", "m.description", "m.canonical")


# ---- changes


@query("WITH d AS (SELECT doc_id, md5(text) AS h FROM documents) SELECT doc_id, n FROM d JOIN (SELECT h, count(*) AS n FROM d GROUP BY h HAVING count(*) > 1) USING (h)")
def soft_duplicates(spark, sf):
    return mutate.soft_duplicates(corpus.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h")), "doc_id", "h")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, min('new'), min(0.0) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY o_custkey")
def insert_or_ignore(spark, sf):
    held = corpus.table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = corpus.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.lit("new").alias("name"), F.lit(0.0).alias("balance"))
    return mutate.insert_or_ignore(held, new, ["id"])


@query("""WITH held AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS kind FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_custkey END AS name, CAST(NULL AS VARCHAR) AS kind FROM customer WHERE c_custkey % 5 = 0)
SELECT coalesce(held.id, new.id) AS id, coalesce(new.name, held.name) AS name, coalesce(new.kind, held.kind) AS kind FROM held FULL JOIN new ON held.id = new.id""")
def upsert(spark, sf):
    own = corpus.table(spark, sf, "customer").withColumnsRenamed({"c_custkey": "id", "c_name": "name", "c_mktsegment": "kind"}).select("id", "name", "kind")
    new = own.filter("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("n"), "id")).alias("name"), F.lit(None).cast("string").alias("kind"))
    return mutate.upsert(own.filter("id % 3 <> 0"), new, ["id"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders WHERE o_orderstatus = 'F'")
def replace_all(spark, sf):
    held = corpus.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = corpus.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return mutate.replace_all(held, new, "l_orderkey")


@query("SELECT l_orderkey AS src, l_linenumber AS ref_number, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey END AS cited_id FROM lineitem WHERE l_orderkey % 7 <> 0")
def cascade_delete(spark, sf):
    refs = corpus.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("ref_number"), F.col("l_partkey").alias("cited_id"))
    ids_ = refs.select(F.col("src").alias("id")).union(refs.select(F.col("cited_id").alias("id"))).filter("id % 7 = 0")
    return mutate.delete_sources({"references": refs}, ids_.withColumn("kind", F.lit("paper")), "paper")["references"].select("src", "ref_number", "cited_id")


#: The corpus of a cascade, made of the given tables; the same text runs in both engines.
CORPUS = {
    "papers": ("SELECT c_custkey AS id, concat('c_', c_custkey) AS slug FROM {customer}", "id"),
    "posts": ("SELECT s_suppkey AS id, concat('s_', s_suppkey) AS slug FROM {supplier}", "id"),
    "repos": ("SELECT p_partkey AS id, CASE WHEN p_size < 40 THEN p_partkey END AS paper_id, p_brand AS name FROM {part}", "id"),
    "references": ("SELECT o_custkey AS paper_id, o_orderkey AS ref_number, CAST(floor(o_orderkey / 10) AS BIGINT) AS cited_paper_id FROM {orders}", "paper_id"),
    "post_references": ("SELECT l_suppkey AS post_id, l_orderkey * 10 + l_linenumber AS ref_number, l_partkey AS cited_paper_id FROM {lineitem}", "post_id"),
    "figures": ("SELECT user_id AS paper_id, event_id AS number, event_type AS caption FROM {events}", "paper_id"),
    "sections": ("SELECT concat('c_', doc_id) AS slug, text AS body FROM {documents}", "slug"),
    "members": ("SELECT DISTINCT 'paper' AS target_kind, o_custkey AS target_id, o_orderpriority AS collection FROM {orders} UNION ALL SELECT 'post', s_suppkey, 'p' FROM {supplier} UNION ALL SELECT 'repo', p_partkey, p_brand FROM {part}", "target_id"),
    "topics": ("SELECT 'paper' AS target_kind, c_custkey AS target_id, concat(c_mktsegment, ' ', c_custkey % 400) AS topic, 'd' AS domain FROM {customer} UNION ALL SELECT 'repo', p_partkey, concat(p_name, ' ', p_partkey % 300), 'd' FROM {part}", "target_id"),
    "terms": ("SELECT DISTINCT concat('t ', topic) AS id, 'topic' AS term_type, topic AS canonical_name, 'd' AS domain FROM {topics} UNION ALL SELECT DISTINCT concat('e ', p_type), 'entity', p_type, 'd' FROM {part} UNION ALL SELECT 't unbound', 'topic', 'unbound', 'd' FROM {region} WHERE r_regionkey = 0", "id"),
    "aliases": ("SELECT concat('t ', c_mktsegment, ' ', c_custkey % 400) AS term_id, upper(c_name) AS alias, concat('c_', (c_custkey * 7) % 1000) AS source FROM {customer}", "term_id"),
    "vectors": ("SELECT id AS term_id, length(canonical_name) AS v FROM {terms}", "term_id"),
    "code_files": ("SELECT l_partkey AS repo_id, concat(l_orderkey, '/', l_linenumber) AS path FROM {lineitem}", "repo_id"),
}


def _stored_corpus(spark: SparkSession, sf: str) -> store.Store:
    given = {n: corpus.table(spark, sf, n) for n in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "region")}
    made: dict[str, DataFrame] = {}
    for name, (text_, _) in CORPUS.items():
        used = {n: df for n, df in (given | made).items() if "{" + n + "}" in text_}
        made[name] = spark.sql(text_, **used)
    own = store.Store(spark, shared.fresh_path(spark, "store"), buckets=8)
    own.create({name: (df, [CORPUS[name][1]]) for name, df in made.items()})
    return own


def _corpus_sql() -> str:
    """CTEs of the corpus under the names t_<table>."""
    filled = lambda x: re.sub(r"\{(\w+)\}", lambda m: f"t_{m[1]}" if m[1] in CORPUS else m[1], x)
    return ", ".join(f"t_{name} AS ({filled(x)})" for name, (x, _) in CORPUS.items())


GONE = "gone AS (SELECT id, slug FROM t_papers WHERE id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))"
DEAD = {
    "papers": "id IN (SELECT id FROM gone)", "repos": "paper_id IN (SELECT id FROM gone)", "references": "paper_id IN (SELECT id FROM gone)", "post_references": "false",
    "figures": "paper_id IN (SELECT id FROM gone)", "sections": "slug IN (SELECT slug FROM gone)",
    "members": "(target_kind = 'paper' AND target_id IN (SELECT id FROM gone)) OR (target_kind = 'repo' AND target_id IN (SELECT id FROM d_repos))",
    "topics": "(target_kind = 'paper' AND target_id IN (SELECT id FROM gone)) OR (target_kind = 'repo' AND target_id IN (SELECT id FROM d_repos))",
    "code_files": "repo_id IN (SELECT id FROM d_repos)", "terms": "term_type = 'topic' AND canonical_name NOT IN (SELECT topic FROM l_topics)",
    "aliases": "source IN (SELECT slug FROM gone) OR term_id IN (SELECT id FROM d_terms)", "vectors": "term_id IN (SELECT id FROM d_terms)",
}
CASCADE = f"""WITH {_corpus_sql()}, {GONE}, {', '.join(f'd_{n} AS (SELECT * FROM t_{n} WHERE {w}), l_{n} AS (SELECT * FROM t_{n} WHERE NOT coalesce({w}, false))' for n, w in DEAD.items())}"""


@query(f"""{CASCADE} {' UNION ALL '.join(f"SELECT '{n}' AS name, (SELECT count(*) FROM d_{n}) AS deleted, " + ("(SELECT count(*) FROM l_" + n + " WHERE cited_paper_id IN (SELECT id FROM gone))" if 'references' in n else 'CAST(0 AS BIGINT)') + f" AS emptied, (SELECT count(*) FROM l_{n}) AS remaining" for n in DEAD)}""")
def cascade_commit(spark, sf):
    """Customers in debt as papers that go, with all that hangs on them, in one commit over thirteen tables: counts before, rows left after."""
    own = _stored_corpus(spark, sf)
    gone = corpus.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    counts = cascade.delete(own, "papers", gone)
    rows = None
    for name, n in counts.items():
        one = own.read(name).agg(F.count("*").alias("remaining")).select(F.lit(name).alias("name"), F.lit(n["deleted"]).cast("long").alias("deleted"), F.lit(n["emptied"]).cast("long").alias("emptied"), "remaining")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(f"""{CASCADE} SELECT 'references' AS name, CAST(paper_id AS VARCHAR) AS owner, ref_number, CASE WHEN cited_paper_id NOT IN (SELECT id FROM gone) THEN cited_paper_id END AS cited FROM l_references
UNION ALL SELECT 'post_references', CAST(post_id AS VARCHAR), ref_number, CASE WHEN cited_paper_id NOT IN (SELECT id FROM gone) THEN cited_paper_id END FROM l_post_references
UNION ALL SELECT 'aliases', alias, NULL, NULL FROM l_aliases UNION ALL SELECT 'terms', id, NULL, NULL FROM l_terms""")
def cascade_rows(spark, sf):
    """What the same delete leaves of references, aliases and terms."""
    own = _stored_corpus(spark, sf)
    cascade.delete(own, "papers", corpus.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id")))
    none = F.lit(None).cast("long")
    refs = [own.read(n).select(F.lit(n).alias("name"), F.col(k).cast("string").alias("owner"), "ref_number", F.col("cited_paper_id").alias("cited")) for n, k in (("references", "paper_id"), ("post_references", "post_id"))]
    names = [own.read(n).select(F.lit(n).alias("name"), F.col(c).alias("owner"), none.alias("ref_number"), none.alias("cited")) for n, c in (("aliases", "alias"), ("terms", "id"))]
    return refs[0].union(refs[1]).union(names[0]).union(names[1])


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def orphan_collection(spark, sf):
    bound = corpus.table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return mutate.collect_orphans(corpus.table(spark, sf, "part").select("p_partkey", "p_brand"), bound, ["p_partkey"])


@query(f"SELECT kind, id, collection, is_primary FROM {derived_sql('lit_members')} WHERE NOT (kind = 'repo' AND id IN (SELECT repo_id FROM {derived_sql('lit_links')})) UNION ALL SELECT 'repo', repo_id, collection, is_primary FROM {derived_sql('lit_members')} JOIN {derived_sql('lit_links')} ON kind = 'paper' AND id = paper_id")
def propagate_memberships(spark, sf):
    return mutate.propagate(derived(spark, sf, "lit_members"), derived(spark, sf, "lit_links"))


@query(f"SELECT kind, id, CAST(sum(CAST(is_primary AS INTEGER)) AS BIGINT) AS n FROM {derived_sql('lit_members')} GROUP BY kind, id HAVING sum(CAST(is_primary AS INTEGER)) > 1")
def invariant_one_primary(spark, sf):
    return mutate.two_primaries(derived(spark, sf, "lit_members"))


@query(f"""WITH o AS (SELECT *, CASE WHEN status LIKE 'failed%' THEN -1 ELSE list_position(['fetched', 'converted', 'classified', 'extracted', 'indexed'], status) - 1 END AS c, list_position(['fetched', 'converted', 'classified', 'extracted', 'indexed'], target) - 1 AS t FROM {derived_sql('lit_events')})
SELECT id, CASE WHEN status IS NULL THEN true WHEN c < 0 THEN false ELSE t - c BETWEEN 0 AND 1 END AS can_run, CASE WHEN c = -1 THEN '' ELSE array_to_string((['fetched', 'converted', 'classified', 'extracted', 'indexed'])[coalesce(c, -1) + 2 :], ',') END AS remaining FROM o""")
def stage_gate(spark, sf):
    own = derived(spark, sf, "lit_events")
    return own.select("id", ingest.can_run(F.col("status"), F.col("target"), ingest.PAPER).alias("can_run"), F.array_join(ingest.remaining(F.col("status"), ingest.PAPER), ",").alias("remaining"))


def _fetched(docs: DataFrame) -> DataFrame:
    """Answers of three tiers for each document: some web pages are missing, of another type, moved or error pages, some files empty."""
    k = F.col("doc_id")
    here = lambda tier, code, kind, url, body: docs.select(k.alias("id"), F.lit(tier).alias("tier"), code.cast("int").alias("code"), kind.alias("content_type"), url.alias("url"), body.alias("body"))
    page = F.concat(F.lit("https://x.org/html/"), k)
    html_ = here("html", F.when(k % 5 == 0, 404).otherwise(200), F.when(k % 7 == 0, "application/pdf").otherwise("Text/HTML; charset=utf-8"), F.when(k % 11 == 0, F.concat(F.lit("https://x.org/abs/"), k)).otherwise(page), F.col("md"))
    mirror = here("mirror", F.lit(200), F.lit("text/html"), page, F.when(k % 3 == 0, "<p>conversion to HTML had a fatal error</p>").otherwise(F.col("md")))
    return html_.union(mirror).union(here("pdf", F.lit(200), F.lit("application/pdf"), page, F.when(k % 2 == 0, F.col("text")).otherwise("  ")))


INGEST = f"""{SECTION_CTES}, {{docs}}
fetched AS (SELECT *, CASE WHEN k % 5 > 0 AND k % 7 > 0 AND k % 11 > 0 AND trim(md) <> '' THEN 'html' WHEN k % 3 > 0 AND trim(md) <> '' THEN 'mirror' WHEN k % 2 = 0 AND trim(text) <> '' THEN 'pdf' END AS tier FROM docs),
named AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY k) = 1 THEN base ELSE base || '_' || right(plain, 5) END AS slug FROM fetched),
placed AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY k) > 1 AS taken FROM named),
staged AS (SELECT *, CASE WHEN tier IS NULL OR taken THEN 'failed_html' WHEN length(body) > 6000 THEN 'fetched' WHEN length(trim(body)) < 200 THEN 'failed_parse' WHEN quality IS NULL THEN 'converted' ELSE 'indexed' END AS status
  FROM (SELECT *, CASE WHEN tier = 'pdf' THEN text ELSE md END AS body FROM placed)),
counted AS (SELECT slug AS m, count(*) FILTER (WHERE trim(raw, {_SPACE}) <> '') AS n FROM sections GROUP BY slug)"""
INGEST_DOCS = f"""docs AS (SELECT d.doc_id AS k, d.text, d.lang, d.source, lit_markdown.md, l.quality, coalesce(d.doc_id, 0) AS kk, 'Paper ' || d.source || ': ' || d.lang AS title, regexp_replace(lower('Paper ' || d.source), '[^a-z0-9]+', '', 'g') || '_' || (2000 + d.doc_id % 25) AS base,
  lpad(CAST(d.doc_id % 10000 AS VARCHAR), 4, '0') || lpad(CAST(d.doc_id * 97 % 100000 AS VARCHAR), 5, '0') AS plain FROM documents d JOIN {derived_sql('lit_markdown')} ON lit_markdown.slug = 'm' || d.doc_id LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),"""


@query(f"""WITH {INGEST.format(docs=INGEST_DOCS)} SELECT k AS id, CASE WHEN NOT taken OR tier IS NULL THEN slug END AS slug, status, tier, CASE WHEN tier IS NULL THEN 'no tier has a usable body' WHEN taken THEN 'slug in use: ' || slug WHEN status = 'fetched' THEN 'too long' END AS error,
  CASE WHEN status = 'indexed' THEN lang END AS domain, CAST(CASE WHEN status <> 'indexed' THEN 0 WHEN tier = 'pdf' THEN 1 ELSE coalesce(n, 0) END AS BIGINT) AS n_sections FROM staged LEFT JOIN counted ON m = 'm' || k""")
def ingest_stages(spark, sf):
    """All documents as sources: stopped after conversion and run again from the start, then the toxic ones forced and run once more."""
    docs, labels = corpus.table(spark, sf, "documents"), corpus.table(spark, sf, "labels")
    docs = docs.join(derived(spark, sf, "lit_markdown").select(F.expr("CAST(substr(slug, 2) AS BIGINT)").alias("doc_id"), "md"), "doc_id")
    k = F.col("doc_id")
    raw = F.concat(F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad((k * 97 % 100000).cast("string"), 5, "0"))
    requests = docs.select(k.alias("id"), F.concat(F.lit("Paper "), "source", F.lit(": "), "lang").alias("title"), F.concat((2000 + k % 25).cast("string"), F.lit("-01-02")).alias("published"), raw.alias("raw_id"))
    good = labels.filter("quality is not null").select("doc_id").distinct()
    decisions = docs.join(good, "doc_id").select(k.alias("id"), F.col("lang").alias("domain"), F.col("source").alias("collection"), F.lit(True).alias("is_primary"), F.lit(False).alias("needs_review"))
    convert = lambda body: F.struct(body.alias("markdown"), F.when(F.length(body) > 6000, "too long").alias("error"))
    at = shared.fresh_path(spark, "ingest")
    own = stages.Ingest(stages.create(spark, f"{at}/store", buckets=8), stages.section_index(spark, f"{at}/index", buckets=8), convert, "2026-01-01")
    own.run(requests, _fetched(docs), decisions, stop_after="converted")
    own.run(requests, _fetched(docs), decisions)
    own.force(labels.filter("toxic = 1").select(F.col("doc_id").alias("id")))
    return own.run(requests, _fetched(docs), decisions).select("id", "slug", "status", "tier", "error", "domain", "n_sections")


# ---- small views


_MEMBERS = """m AS (SELECT DISTINCT * FROM (SELECT 'paper' AS kind, o_custkey AS id, o_orderstatus AS domain, o_orderpriority AS collection FROM orders UNION ALL SELECT 'repo', p_partkey, 'P', p_type FROM part UNION ALL SELECT 'post', s_suppkey, 'F', '1-URGENT' FROM supplier))"""


def _members(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda name, kind, key, domain, collection: corpus.table(spark, sf, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), domain.alias("domain"), collection.alias("collection"))
    return of("orders", "paper", "o_custkey", F.col("o_orderstatus"), F.col("o_orderpriority")).union(of("part", "repo", "p_partkey", F.lit("P"), F.col("p_type"))).union(of("supplier", "post", "s_suppkey", F.lit("F"), F.lit("1-URGENT")))


_KIND_COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS n_{k}" for k in taxonomy.KINDS)


@query(f"""WITH {_MEMBERS}, s AS (SELECT DISTINCT kind, id, domain FROM m), c AS (SELECT domain, NULL AS collection, {_KIND_COUNTS} FROM s GROUP BY domain UNION ALL SELECT domain, collection, {_KIND_COUNTS} FROM m GROUP BY domain, collection),
named AS (SELECT DISTINCT o_orderstatus AS domain FROM orders UNION SELECT n_name FROM nation), defined AS (SELECT DISTINCT o_orderstatus AS domain, o_orderpriority AS collection FROM orders UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
every AS (SELECT domain, CAST(NULL AS VARCHAR) AS collection FROM named UNION ALL SELECT * FROM defined)
SELECT every.domain, every.collection, coalesce(n_paper, 0) AS n_paper, coalesce(n_post, 0) AS n_post, coalesce(n_repo, 0) AS n_repo FROM every LEFT JOIN c ON c.domain = every.domain AND c.collection IS NOT DISTINCT FROM every.collection""")
def taxonomy_tree(spark, sf):
    """Order states and nations as domains; nations have no source, their collections no member."""
    orders, nation, region = (corpus.table(spark, sf, n) for n in ("orders", "nation", "region"))
    members = _members(spark, sf)
    domains = orders.select(F.col("o_orderstatus").alias("domain")).union(nation.select("n_name")).distinct()
    defined = orders.select(F.col("o_orderstatus").alias("domain"), F.col("o_orderpriority").alias("collection")).union(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")).distinct()
    return taxonomy.tree(domains, defined, members.select("kind", "id", "domain").distinct(), members)


@query(f"WITH {_MEMBERS} SELECT *, n_paper > 20 AS more_paper, n_post > 20 AS more_post, n_repo > 20 AS more_repo FROM (SELECT domain, collection, {_KIND_COUNTS} FROM m GROUP BY domain, collection)")
def collection_totals(spark, sf):
    return taxonomy.collection_totals(_members(spark, sf), 20)


@query("SELECT l_orderkey AS id, count(DISTINCT p_name) AS n_terms FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def distinct_terms(spark, sf):
    own = corpus.table(spark, sf, "lineitem").join(corpus.table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return taxonomy.distinct_terms(own.select(F.col("l_orderkey").alias("id"), F.col("p_name").alias("term")), "id")


@query("SELECT event_type AS kind, count(*) AS n, count(*) FILTER (WHERE event_id = first) AS first_slots FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS first FROM events) GROUP BY event_type")
def search_diversity(spark, sf):
    """Events as results: each user a query, in the order of their ids."""
    return taxonomy.diversity(corpus.table(spark, sf, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("rank"), F.col("event_type").alias("kind")))


@query("""SELECT o_orderkey AS id, round(-o_totalprice * (1 + 0.2 * CASE WHEN d IS NULL THEN 0.0 WHEN date_diff('day', d, DATE '2026-01-01') < 365 THEN 1.0 WHEN date_diff('day', d, DATE '2026-01-01') < 1095 THEN 0.5 ELSE 0.1 END), 4) AS score
FROM (SELECT *, CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_orderdate AS DATE) + INTERVAL 2 YEAR END AS d FROM orders)""")
def recency_by_steps(spark, sf):
    date = F.when(F.col("o_orderkey") % 10 > 0, F.add_months(F.to_date("o_orderdate"), 24))
    return corpus.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(search.recency_steps(-F.col("o_totalprice"), date, 0.2, AS_OF), 4).alias("score"))


@query("""SELECT id, array_to_string(list_distinct_in_order, ',') AS refs FROM (SELECT id, list_filter(f, lambda x, i: list_position(f, x) = i) AS list_distinct_in_order
FROM (SELECT o_orderkey AS id, list_transform(regexp_extract_all('see (figure:' || o_custkey || ') and ![x](figure:0' || o_orderkey % 7 || '), again (figure:' || o_custkey || '), (figure: 3) (figure:x) (figure:' || o_orderkey % 7 || ')', '\\(figure:(\\d{1,9})\\)', 1), lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)) AS f FROM orders))""")
def figure_refs(spark, sf):
    key, seventh = F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 7).cast("string")
    said = F.concat(F.lit("see (figure:"), key, F.lit(") and ![x](figure:0"), seventh, F.lit("), again (figure:"), key, F.lit("), (figure: 3) (figure:x) (figure:"), seventh, F.lit(")"))
    return corpus.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.transform(text.figure_refs(said), lambda n: n.cast("string")), ",").alias("refs"))


@query("""SELECT p_partkey AS id FROM part WHERE (replace(p_name, ' ', '_') || '__ch' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '_x') LIKE (replace(replace(CASE WHEN p_partkey % 3 = 0 THEN left(p_name, 2) || '%' ELSE replace(p_name, ' ', '_') END, '%', '!%'), '_', '!_') || '!_!_ch' || lpad(CAST(p_size - p_size % 2 AS VARCHAR), 2, '0') || '!_%') ESCAPE '!'""")
def chapter_slots(spark, sf):
    """Chapters in the even slots of their own books; every third book is asked for by a name with a wildcard, which matches nothing."""
    size = F.col("p_size")
    plain = F.replace("p_name", F.lit(" "), F.lit("_"))
    slug = F.concat(plain, F.lit("__ch"), F.lpad(size.cast("string"), 2, "0"), F.lit("_x"))
    book = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.left("p_name", F.lit(2)), F.lit("%"))).otherwise(plain)
    return corpus.table(spark, sf, "part").filter(ids.in_slot(slug, book, size - size % 2)).select(F.col("p_partkey").alias("id"))


# ---- guarded SQL and the catalog


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY n_regionkey")
def guarded_sql(spark, sf):
    corpus.table(spark, sf, "nation").createOrReplaceTempView("nation")
    out = guarded.run(spark, "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY n_regionkey", most_seconds=60)
    return spark.createDataFrame([(r["region"], r["n"]) for r in out["rows"]], "region int, n long")


@query("SELECT * FROM (VALUES ('DROP TABLE x', 'read_only_violation'), ('SELECT 1; SELECT 2', 'multiple_statements'), ('SELEC 1', 'query_failed'), ('SELECT nope FROM nation', 'query_failed'), ('SELECT '';'' AS a', 'ok'), ('INSERT INTO x VALUES (1)', 'read_only_violation'), ('SET a=b', 'read_only_violation')) AS t(sql, status)")
def guarded_statuses(spark, sf):
    corpus.table(spark, sf, "nation").createOrReplaceTempView("nation")
    said = ["DROP TABLE x", "SELECT 1; SELECT 2", "SELEC 1", "SELECT nope FROM nation", "SELECT ';' AS a", "INSERT INTO x VALUES (1)", "SET a=b"]
    return spark.createDataFrame([(s, guarded.run(spark, s, most_seconds=60)["status"]) for s in said], "sql string, status string")


@query("SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) AS t(name, type)")
def table_schema(spark, sf):
    corpus.table(spark, sf, "nation").createOrReplaceTempView("nation")
    return spark.createDataFrame([(c["name"], c["type"]) for c in guarded.schema(spark, ["nation"])["tables"]["nation"]], "name string, type string")


# ---- sets


@query("SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT DISTINCT o_orderpriority FROM orders UNION SELECT DISTINCT p_brand FROM part")
def distinct_union(spark, sf):
    parts = [corpus.table(spark, sf, t).select(F.col(c).alias("name")) for t, c in (("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("part", "p_brand"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("SELECT event_type, CAST(row_number() OVER (ORDER BY min(event_id)) AS INTEGER) AS place FROM events GROUP BY event_type")
def ordered_dedupe(spark, sf):
    own = corpus.table(spark, sf, "events").groupBy("event_type").agg(F.min("event_id").alias("first"))
    return own.select("event_type", F.row_number().over(Window.orderBy("first")).alias("place"))


@query("SELECT l_returnflag AS source, count(*) AS n, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS rejected, count(*) >= 10 AND avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) > 0.5 AS warn FROM lineitem GROUP BY l_returnflag")
def reject_rates(spark, sf):
    rate = F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0))
    return corpus.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("source")).agg(F.count("*").alias("n"), F.round(rate, 6).alias("rejected"), ((F.count("*") >= 10) & (rate > 0.5)).alias("warn"))


# ---- other formats, classification


@query("""SELECT n_name AS domain, r_name || ' a' AS collection, 'x' AS description FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, n_name || ' b', CAST(n_nationkey AS VARCHAR) FROM nation
UNION ALL SELECT 'empty ' || n_nationkey, NULL, NULL FROM nation""")
def taxonomy_json(spark, sf):
    return formats.taxonomy(derived(spark, sf, "lit_taxonomy"), "j")


@query("""SELECT s_suppkey AS id, 'Title ' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ': with ' || s_nationkey ELSE '' END AS title, s_name || ' Lee' AS authors, (1990 + s_nationkey) || '-01-01' AS date FROM supplier WHERE s_suppkey % 5 > 0
UNION ALL SELECT s_suppkey, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 5 = 0""")
def anthology_record(spark, sf):
    return derived(spark, sf, "lit_mods").select("id", formats.mods(F.col("x")).alias("m")).select("id", "m.title", F.array_join("m.authors", ";").alias("authors"), "m.date")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 9 > 0 THEN '# %% [markdown]' || chr(10) || '# ' || c_name || chr(10) || 'there' || chr(10) || chr(10) || '# %%' || chr(10) || 'x = ' || c_nationkey END AS flat FROM customer")
def notebook_flat(spark, sf):
    return derived(spark, sf, "lit_notebooks").select("id", formats.notebook(F.col("c")).alias("flat"))


_PAD = "lpad(CAST(({0}) % {1} AS VARCHAR), {2}, '0')"


@query(f"""SELECT DISTINCT id, cited FROM (SELECT o_orderkey AS id, {_PAD.format('o_custkey', 10000, 4)} || '.' || {_PAD.format('o_orderkey', 100000, 5)} AS cited FROM orders
UNION ALL SELECT o_orderkey, {_PAD.format('o_custkey', 10000, 4)} || '.' || {_PAD.format('o_custkey', 100000, 5)} FROM orders UNION ALL SELECT o_orderkey, 'cs/' || {_PAD.format('o_orderkey', 10000000, 7)} FROM orders WHERE o_orderkey % 3 = 0)""")
def post_citations(spark, sf):
    return formats.post_references(derived(spark, sf, "lit_posts"), "id", "t").select("id", "cited")


@query("""WITH d AS (SELECT DISTINCT p_brand AS domain, p_type AS collection FROM part WHERE p_size > 20), k AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS domain_index FROM (SELECT DISTINCT domain FROM d)),
n AS (SELECT domain, collection, row_number() OVER (PARTITION BY domain ORDER BY collection) - 1 AS i FROM d),
picks AS (SELECT c_custkey, c_nationkey, k.domain AS known, coalesce(k.domain, 'new_' || c_nationkey) AS domain, unnest([0, 1, 2]) AS place FROM customer LEFT JOIN k ON c_custkey % 30 = domain_index),
said AS (SELECT p.*, CASE place WHEN 0 THEN a.collection WHEN 1 THEN coalesce(b.collection, c_name) ELSE a.collection END AS collection, CASE place WHEN 1 THEN b.collection IS NULL ELSE a.collection IS NULL END OR known IS NULL AS fresh
  FROM (SELECT picks.*, c_name FROM picks JOIN customer USING (c_custkey)) p LEFT JOIN n a ON a.domain = p.domain AND a.i = c_custkey % 7 LEFT JOIN n b ON b.domain = p.domain AND lower(b.collection) = lower(c_name) ),
once AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, lower(collection) ORDER BY place) AS r FROM said WHERE collection IS NOT NULL)
SELECT 'p' || c_custkey AS slug, domain, collection, place = min(place) OVER (PARTITION BY c_custkey) AS is_primary, bool_or(fresh) OVER (PARTITION BY c_custkey) AS needs_review FROM once WHERE r = 1""")
def classification_decisions(spark, sf):
    """Each customer as a result: a domain by number or a new one, a collection by number, one by name, the first again."""
    known = corpus.table(spark, sf, "part").filter("p_size > 20").select(F.col("p_brand").alias("domain"), F.col("p_type").alias("collection")).distinct()
    n_domains = known.select("domain").distinct().count()
    number = (F.col("c_custkey") % 30).cast("int")
    pick = lambda i, name: F.struct(i.cast("int").alias("index"), name.cast("string").alias("new_name"))
    none, by_number = F.lit(None), F.col("c_custkey") % 7
    own = corpus.table(spark, sf, "customer").select(F.concat(F.lit("p"), "c_custkey").alias("slug"), F.when(number < n_domains, number).otherwise(-1).alias("domain_index"), F.when(number >= n_domains, F.concat(F.lit("New "), "c_nationkey")).alias("new_domain"), F.array(pick(by_number, none), pick(none, F.col("c_name")), pick(by_number, none)).alias("picks"))
    return classify.decide(own, known).drop("place")


@query("""SELECT CAST(rank AS INTEGER) AS rank, slug FROM (SELECT slug, row_number() OVER (PARTITION BY kind ORDER BY n) AS rank FROM (SELECT 'doc_' || doc_id AS slug, lang AS kind, doc_id AS n FROM documents)) WHERE rank = 1""")
def first_of_kind(spark, sf):
    own = corpus.sources(spark, sf)
    w = Window.partitionBy("domain").orderBy("id")
    return own.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("rank", "slug")
