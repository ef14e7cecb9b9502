"""Shapes that the given tables have no rows of, made of their rows: one SELECT each, in words that Spark and DuckDB both read.

Each row of a given table takes one of several forms by its number, with its own numbers and names filled in, so these tables grow with the given ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.corpus import table


def forms(number: str, *said: str) -> str:
    """One of the expressions for each row, in turn by a number."""
    return f"CASE ({number}) % {len(said)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(said)) + " END"


def digits(number: str, n: int) -> str:
    return f"lpad(CAST(({number}) % {10**n} AS STRING), {n}, '0')"


K, NL = "p_partkey", "chr(10)"
MODERN = f"concat({digits(K, 4)}, '.', {digits('p_partkey * 7919', 5)})"
LEGACY = f"concat('cs/', {digits('p_partkey * 31', 7)})"
REF = f"concat({digits('l_partkey', 4)}, '.', {digits('l_orderkey', 5)})"
HEAD = f"replace(substr(text, 1, 40), {NL}, ' ')"
OPEN, CLOSE, SLASH = "chr(123)", "chr(125)", "chr(92)"

DERIVED: dict[str, str] = {
    "lit_terms": f"SELECT p_partkey AS term_id, p_brand AS domain, {forms(K, chr(39) + 'entity' + chr(39), chr(39) + 'topic' + chr(39))} AS term_type, {forms('p_size', 'p_name', 'concat(p_name, ' + chr(39) + ' model' + chr(39) + ')', 'concat(p_name, ' + chr(39) + '-' + chr(39) + ', p_size)', 'concat(upper(p_name), ' + chr(39) + ' dataset' + chr(39) + ')', 'concat(p_type, ' + chr(39) + ' ' + chr(39) + ', p_name)')} AS canonical_name FROM {{part}}",
    "lit_aliases": "SELECT p_partkey AS term_id, concat(upper(substr(p_name, 1, 3)), p_size, ' framework') AS alias FROM {part} WHERE p_size > 25",
    "lit_names": f"SELECT p_partkey AS ord, {forms('p_partkey % 11', 'p_name', 'concat(upper(p_name), chr(33))', 'concat(p_name, chr(32), chr(32), p_size)', 'concat(lower(substr(p_name, 1, 3)), p_size)', 'concat(chr(32), p_name, chr(45), chr(45))', 'concat(p_name, p_partkey)', 'concat(substr(p_name, 2, 30), p_type)')} AS raw, p_brand AS domain, CASE WHEN p_partkey % 3 = 0 THEN 'topic' ELSE 'entity' END AS term_type FROM {{part}}",
    "lit_ids": "SELECT " + forms(
        K, f"concat('https://arxiv.org/abs/', {MODERN}, 'v', p_size)", f"concat('http://arxiv.org/pdf/', {MODERN}, '.pdf')", LEGACY, f"concat({digits(K, 4)}, '.', p_size)", "concat(2000 + p_size, '.acl-long.', p_partkey)",
        f"concat('https://aclanthology.org/P', {digits(K, 2)}, '-', {digits(K, 4)}, '.pdf')", "concat('www.aclanthology.org/2021.acl-long.', p_partkey, '/')", "concat('https://github.com/', replace(p_brand, '#', '-'), '/Repo', p_partkey, '.git')",
        "concat('https://www.gitlab.com/', p_type, '/b', p_size, '/')", "concat('https://github.com/a/b/issues/', p_partkey)", "concat('https://github.com/', p_type)", "concat('https://example.com/a/b', p_partkey)",
        "concat('see (https://bitbucket.org/x/y', p_size, ').')", "concat('https://bitbucket.org/x/y', p_partkey, ').')", f"concat('  ', {MODERN}, 'v1 ')", "''",
        f"concat('https://arxiv.org/html/', {MODERN}, '/', {MODERN}, 'v', p_size, '/x', p_size, '.png')", f"concat('https://arxiv.org/html/', {MODERN}, 'v3/latex/fig', p_partkey, '.png')", f"concat('https://arxiv.org/html/', {LEGACY}, '/', {LEGACY}, '/x.png')",
    ) + " AS raw FROM {part}",
    "lit_refs": "SELECT l_orderkey AS src, CAST(l_linenumber AS BIGINT) AS ref_number, " + forms(
        "l_orderkey + l_linenumber", f"concat('Smith et al. arXiv:', {REF}, 'v3, 2023')", f"concat('ARXIV: CS/', {digits('l_partkey * 37', 7)})", f"concat('Lee, https://arxiv.org/abs/', {REF}, 'v2')", "concat('No id here ', l_partkey)",
        f"concat('arXiv: ', {digits('l_partkey', 4)}, '.', l_linenumber, ' too short')", f"concat('two: arXiv:', {REF}, ' and arXiv:2401.00001')", f"concat('www.arxiv.org/abs/', {digits('l_partkey', 4)}, '.', {digits('l_partkey', 4)})", "''",
    ) + " AS raw_text FROM {lineitem}",
    "lit_titles": f"SELECT {forms('doc_id', f'concat({HEAD}, chr(58), chr(32), source)', HEAD, chr(39) + '日本語' + chr(39), f'concat(source, chr(32), {HEAD})')} AS title, concat(2000 + doc_id % 25, '-0', 1 + doc_id % 9, '-02') AS date, concat({digits('doc_id', 4)}, '.', {digits('doc_id * 97', 5)}, {forms('doc_id', chr(39) + chr(39), chr(39) + 'v2' + chr(39))}) AS id FROM {{documents}} WHERE text <> ''",
    "lit_domains": "SELECT " + forms("doc_id", "substr(text, 1, 90)", "concat(source, ' / ', lang, ' NLP')", "concat('  --', source, '__')", "repeat(lang, 40)", "''") + " AS name FROM {documents}",
    "lit_headings": "SELECT " + forms(K, "concat(p_size, '.', p_partkey % 9, '.2 ', p_name, ':')", "concat('**', p_name, '   ', p_type, '**')", "concat('*', p_name, '*')", "p_name", "concat(p_size, '. ', p_type)", "concat('__', p_name, '__')", "concat(p_name, ' ::')", "concat('**', p_name, '*')", "concat('_', p_type, '_ ')") + " AS title FROM {part}",
    "lit_spans": "SELECT l_orderkey AS doc, l_partkey % 3 AS start, concat('t', l_suppkey % 50) AS norm, " + forms("l_partkey", "'model'", "'method'", "'dataset'", "'metric'") + " AS label, l_quantity / 50.0 AS score, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey AS ord FROM {lineitem}",
    "lit_evidence": "SELECT l_partkey AS term, l_orderkey * 10 + l_linenumber AS ord, " + forms("l_suppkey", "'A'", "'B'", "'C'", "''") + " AS label, l_quantity / 50.0 AS score FROM {lineitem}",
    "lit_entities": "SELECT " + forms(
        K, "p_name", "''", "repeat(' ', CAST(p_size AS INT))", f"concat(p_name, {NL}, 'b')", "CAST(p_partkey AS STRING)", "concat(p_type, '-')", "concat('+', p_size, '.6%')", "concat('-', p_name)", "repeat(p_name, 20)", "concat('Table ', p_size)", "concat('Fig. ', p_size, 'a')",
        "concat('Table ', p_size, ' three')", "concat(p_size, '.9 ms')", "concat(p_size, ' docs')", "concat(p_size, 'K')", "'Vector'", "'json'", "'Dataset'", "'dataset model'", "'QA'", "substr(p_type, 1, 2)", "concat('GPT-', p_size)", "concat(p_size, 'D scene', chr(33))", "concat('Section ', p_size, '.1')",
    ) + " AS name FROM {part}",
    "lit_files": f"SELECT concat('r', doc_id % 50) AS repo, concat({forms('doc_id', *(chr(39) + x + chr(39) for x in ('', 'src/', 'node_modules/', 'a.egg-info/', 'docs/', 'builds/', 'build/')))}, {forms('doc_id', *(chr(39) + x + chr(39) for x in ('README.md', 'main.py', 'logo.PNG', 'package-lock.json', 'big.json', 'app.js', 'style.css', 'Dockerfile', 'events.out.tfevents.1', 'readme.RST', 'a.ipynb', '.gitignore', 'README')))}) AS path, n_chars * 40 AS size, {forms('doc_id', 'text', 'substr(text, 1, 300)', f'replace(text, chr(32), {NL})', 'concat(' + chr(39) + '�' + chr(39) + ', text)', 'concat(' + chr(39) + '�' + chr(39) + ', substr(text, 1, 40))', 'concat(substr(text, 1, 100), chr(0), text)')} AS content FROM {{documents}} WHERE text IS NOT NULL",
    "lit_outline": "SELECT concat('b', o_custkey) AS book, o_orderkey AS ord, CAST(1 + o_orderkey % 2 AS BIGINT) AS level, concat('Ch ', o_orderpriority, ' ') AS title, CAST(CASE WHEN o_custkey % 7 = 0 THEN o_orderkey * 37 % 100 ELSE floor(o_orderkey / 50) END AS BIGINT) AS page, CAST(100000 AS BIGINT) AS pages FROM {orders}",
    "lit_markdown": f"SELECT concat('m', doc_id) AS slug, " + forms(
        "doc_id", f"concat('Before all.', {NL}, {NL}, '# Top ', {HEAD}, {NL}, text, {NL}, '## Setup', {NL}, 'first ', doc_id, {NL}, '```python', {NL}, '# not a header', {NL}, '```', {NL}, '### Deep *x*', {NL}, 'deep', {NL}, '# Other', {NL}, '## Setup', {NL}, 'second', {NL})",
        f"concat('# A', {NL}, '~~~', {NL}, '# inside', {NL}, '```', {NL}, '# outside again', {NL}, '#### four stays', {NL}, text, {NL}, '## 2.1 **Setup**:  ', {NL}, source)", "text", f"concat('   ', {NL}, '## Only', {NL}, '### Empty', {NL}, '### Setup', {NL}, text, {NL}, '### ', lang, {NL}, '# End')",
    ) + " AS md FROM {documents}",
    "lit_events": "SELECT 'paper' AS kind, o_orderkey AS id, " + forms("o_orderkey", "CAST(NULL AS STRING)", "'fetched'", "'converted'", "'classified'", "'extracted'", "'indexed'", "'failed_html'") + " AS status, " + forms("o_custkey", "'fetched'", "'converted'", "'classified'", "'extracted'", "'indexed'") + " AS target FROM {orders}",
    "lit_members": "SELECT DISTINCT 'paper' AS kind, o_custkey AS id, o_orderpriority AS collection, o_orderpriority < '3' AS is_primary FROM {orders} UNION ALL SELECT 'repo', p_partkey, p_type, true FROM {part}",
    "lit_links": "SELECT c_custkey AS paper_id, c_custkey * 3 AS repo_id FROM {customer} WHERE c_nationkey % 2 = 0",
    "lit_acronyms": "SELECT p_partkey AS id, " + forms(
        K, "concat('We use Reciprocal Rank Fusion (RRF) and ', p_name, ' packing (', upper(substr(p_name, 1, 1)), upper(split_part(p_name, ' ', 1)), ').')", "concat('no pairs (', p_name, ')')", "concat('Best Matching ', p_size, ' (BM', p_size, ')')", "concat('Maximal Marginal Relevance (Mmr), ', p_type)",
        "concat(p_name, ' retrieval (', upper(substr(p_name, 1, 1)), upper(substr(split_part(p_name, ' ', 2), 1, 1)), 'R) again')",
    ) + " AS text FROM {part}",
    "lit_taxonomy": f"SELECT n_nationkey AS id, concat({OPEN}, '\"domains\":[', {OPEN}, '\"name\":\"', n_name, '\",\"description\":\"', n_regionkey, '\",\"collections\":[', {OPEN}, '\"name\":\"', r_name, ' a\",\"description\":\"x\"', {CLOSE}, ',', {OPEN}, '\"name\":\"', n_name, ' b\",\"description\":\"', n_nationkey, '\"', {CLOSE}, ']', {CLOSE}, ',', {OPEN}, '\"name\":\"empty ', n_nationkey, '\",\"description\":\"\",\"collections\":[]', {CLOSE}, '],\"merge_notes\":1', {CLOSE}) AS j FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey",
    "lit_mods": "SELECT s_suppkey AS id, concat('<modsCollection xmlns=\"http://www.loc.gov/mods/v3\"><mods><titleInfo><title>Title ', s_suppkey, '</title>', CASE WHEN s_suppkey % 2 = 0 THEN concat('<subTitle>with ', s_nationkey, '</subTitle>') ELSE '' END, '</titleInfo><name type=\"personal\"><namePart type=\"given\">', s_name, '</namePart><namePart type=\"family\">Lee</namePart><role><roleTerm>author</roleTerm></role></name><name type=\"personal\"><namePart type=\"given\">Ed</namePart><namePart type=\"family\">Itor</namePart><role><roleTerm>editor</roleTerm></role></name><originInfo>', CASE WHEN s_suppkey % 5 > 0 THEN concat('<dateIssued>', 1990 + s_nationkey, '-08</dateIssued>') ELSE '' END, '</originInfo></mods></modsCollection>') AS x FROM {supplier}",
    "lit_notebooks": f"SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'no notebook' ELSE concat({OPEN}, '\"cells\":[', {OPEN}, '\"cell_type\":\"markdown\",\"source\":[\"# ', c_name, {SLASH}, 'n\",\"there\"]', {CLOSE}, ',', {OPEN}, '\"cell_type\":\"code\",\"source\":\"x = ', c_nationkey, '\",\"outputs\":[', {OPEN}, '\"text\":\"no\"', {CLOSE}, ']', {CLOSE}, ',', {OPEN}, '\"cell_type\":\"raw\",\"source\":[\"z\"]', {CLOSE}, ']', {CLOSE}) END AS c FROM {{customer}}",
    "lit_posts": f"SELECT o_orderkey AS id, concat('See arXiv:', {digits('o_custkey', 4)}, '.', {digits('o_orderkey', 5)}, 'v2 and https://arxiv.org/abs/', {digits('o_custkey', 4)}, '.', {digits('o_custkey', 5)}, ', again arXiv: ', {digits('o_custkey', 4)}, '.', {digits('o_orderkey', 5)}, '. ', CASE WHEN o_orderkey % 3 = 0 THEN concat('Old: arXiv:CS/', {digits('o_orderkey', 7)}) ELSE o_orderpriority END) AS t FROM {{orders}}",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = DERIVED[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def derived_sql(name: str) -> str:
    """The same rows as a subquery for DuckDB."""
    return f"({re.sub(r'[{}]', '', DERIVED[name])}) AS {name}"
