"""Secret scans with multipart credential linking, in DataFrame functions only.

Base finds (assignments, access identifiers, long hex) stand on their own. Weak candidates (account names, short or unnamed
secrets, endpoints) are reported only where complementary parts lie within `reach` code points in the same scope, a block of
text between blank lines. The link is an interval join by range frames over the parts' places, linear in their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def either_case(word: str) -> str:
    """A pattern for the word with its letters in either case, the same in Java's and RE2's syntax."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _named(words: str, value: str) -> str:
    return f"({'|'.join(either_case(w) for w in words.split('|'))})[\"']?\\x20*[:=]\\x20*[\"']?({value})"


#: kind -> pattern, in the order of the kinds.
PATTERNS = {
    "assign": _named("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+"),
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",  # of runs of hex signs, the same as those of 24 or more
    "ident": _named("access_?key_?id|client_?id|account|username|user|login", "[A-Za-z0-9_.@-]{3,}"),
    "blob": "[A-Za-z0-9+/]{32,}",
    "endpoint": "(?:https?|ftp|ssh|s3|jdbc:[a-z0-9]+)://[^\\x00-\\x20\"'<>]{3,}",
    "break": "\\n[\\x20\\t\\r]*\\n",
}
KINDS = list(PATTERNS)
#: In a text without this there is no weak candidate; it may be there without one.
WEAK = "|".join([PATTERNS["ident"], PATTERNS["blob"], PATTERNS["endpoint"], _named("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]{1,5}(?![A-Za-z0-9+/_.=-])")])
BASE, ORDER = ("assign", "access", "hex"), ("assign", "access", "hex", "ident", "blob", "endpoint", "short")
LEAST = {"assign": 6, "access": 20, "hex": 24}


def places(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches: code points, end exclusive, and the match.

    The text between matches gives the starts: the k-th match begins after k+1 gaps and k matches.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("n"), m.alias("m")))
    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")),
        lambda a, x: F.struct((a["at"] + x["g"] + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["n"]).alias("e"), x["m"].alias("m")))).alias("out")),
        lambda a: a["out"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _parts(kind: str, text: Column) -> Column:
    """array<struct<s, k, e>> of a kind's candidates; k is the place of the kind in ORDER, 9 for a blank line."""
    found = places(text, PATTERNS[kind])
    if kind == "assign":  # a value that is too short makes it a weak candidate
        value = lambda m: F.length(F.regexp_extract(m, PATTERNS["assign"], 2))
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.when(value(x["m"]) >= LEAST["assign"], 0).otherwise(6).alias("k"), x["e"].alias("e")))
    if kind in LEAST:
        found = F.filter(found, lambda x: x["e"] - x["s"] >= LEAST[kind])
    if kind == "blob":
        found = F.filter(found, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]"))
    k = 9 if kind == "break" else ORDER.index(kind)
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = 200, carry: list[str] | None = None) -> DataFrame:
    """A row for each document: the columns of `carry` (the id alone if None), then base and spans.

    base, spans: array<struct<s, k, e>> by start, then kind (an index into ORDER); spans holds the base ones and the linked weak ones:
    an account name with a secret near it, a short or unnamed secret with an account or access identifier near it or an endpoint,
    an endpoint with both a secret and an identifier near it. `Near`: the starts lie at most `reach` code points apart, in one scope.

    A null text counts as empty. Repeated rows are rows of their own; null ids are carried. An empty table gives no rows.
    Rows without a weak candidate are done where they lie; only the others, with their columns of `carry`, are shuffled for the link.
    """
    columns = [id_column] if carry is None else carry
    text = F.coalesce(F.col(text_column), F.lit(""))
    alone = F.array_sort(F.filter(F.concat(*(_parts(k, text) for k in BASE)), lambda x: x["k"] < 3))
    plain = docs.filter(~text.rlike(WEAK)).select(*columns, alone.alias("base")).withColumn("spans", F.col("base"))
    rows = docs.filter(text.rlike(WEAK)).select(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))).alias("own"), F.monotonically_increasing_id().alias("row"), F.concat(*(_parts(k, text) for k in KINDS)).alias("parts"))
    rows = rows.select("own", "row", F.filter("parts", lambda x: x["k"] < 3).alias("base"), F.array_sort("parts").alias("parts"))
    parts = rows.select("own", "row", "base", F.posexplode_outer("parts").alias("pos", "part")).select(F.when(F.coalesce("pos", F.lit(0)) == 0, F.struct("own", "base")).alias("first"), "row", "part.*").repartition("row")
    scope = F.sum(F.when(F.col("k") == 9, 1).otherwise(0)).over(Window.partitionBy("row").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = Window.partitionBy("row", "scope").orderBy("s").rangeBetween(-reach, reach)
    has = lambda *ks: F.max(F.col("k").isin(*ks)).over(near)
    # 0 assign, 1 access, 2 hex, 3 ident, 4 blob, 5 endpoint, 6 short
    tied = parts.withColumn("scope", F.coalesce(scope, F.lit(0))).withColumns({"id": has(1, 3), "secret": has(0, 2, 4, 6), "place": has(5)})
    reported = F.col("k").isin(3) & F.col("secret") | F.col("k").isin(4, 6) & (F.col("id") | F.col("place")) | F.col("k").isin(5) & F.col("secret") & F.col("id")
    again = tied.groupBy("row").agg(F.first("first", ignorenulls=True).alias("first"), F.collect_list(F.when(reported, F.struct("s", "k", "e"))).alias("weak"))
    linked = again.select(*(F.col(f"first.own.c{i}").alias(c) for i, c in enumerate(columns)), F.array_sort("first.base").alias("base"), F.array_sort(F.concat("first.base", "weak")).alias("spans"))
    return plain.union(linked)


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and digests of the finds: n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(id_column, *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced by the mark; spans as scan() gives them."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    walked = F.aggregate(
        spans,
        start,
        lambda a, x: F.when(x["e"] <= a["at"], a).otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when((x["s"] < a["at"]), a["out"]).otherwise(F.concat(a["out"], text.substr((a["at"] + 1).cast("int"), (x["s"] - a["at"]).cast("int")), F.lit(mark))).alias("out"))),
        lambda a: F.concat(a["out"], text.substr((a["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, walked).otherwise(text)


def oracle(reach: int = 200) -> str:
    """DuckDB's SQL for the query's rows."""
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    found = []
    for kind, p in quoted.items():
        k = 9 if kind == "break" else ORDER.index(kind)
        if kind == "assign":
            code, keep_if = f"CASE WHEN length(regexp_extract(m, '{p}', 2)) >= 6 THEN 0 ELSE 6 END", "true"
        else:
            code, keep_if = str(k), {"access": "length(m) >= 20", "hex": "length(m) >= 24", "blob": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"}.get(kind, "true")
        found.append(f"""
SELECT rid, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s, {code} AS k, length(m) AS n
FROM (SELECT rid, ms, gaps, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m FROM (SELECT rid, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gaps FROM d WHERE regexp_matches(text, '{p}')))
WHERE {keep_if}""")
    names = "['" + "', '".join(ORDER) + "']"
    joined = f"string_agg({names}[k + 1] || ':' || s || ':' || (s + n), ',' ORDER BY s, k)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT rid, CAST(s AS BIGINT) AS s, k, n FROM ({' UNION ALL '.join(found)})),
scoped AS (SELECT *, sum(CASE WHEN k = 9 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s, k ROWS UNBOUNDED PRECEDING) AS scope FROM parts),
tied AS (SELECT *, bool_or(k IN (1, 3)) OVER w AS id, bool_or(k IN (0, 2, 4, 6)) OVER w AS secret, bool_or(k = 5) OVER w AS place FROM scoped
  WINDOW w AS (PARTITION BY rid, scope ORDER BY s RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)),
shown AS (SELECT * FROM tied WHERE k < 3 OR k = 3 AND secret OR k IN (4, 6) AND (id OR place) OR k = 5 AND secret AND id),
per AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, coalesce({joined} FILTER (k < 3), '') AS base, {joined} AS spans FROM shown GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (rid)
"""
