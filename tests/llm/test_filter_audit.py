import itertools
import re
from collections import Counter, defaultdict

import duckdb

from corpusloom.llm import filter_audit
from corpusloom.llm.queries import op13_filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    first, good, toxic = {}, {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    parts = defaultdict(list)
    for d, t, source in docs:
        text = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {f for f, x in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search("[#$%&*|]", text), d is not None and d > first[text]), strict=True) if x}
        parts[source or ""].append((fails, d is not None and d in good, d is not None and d in toxic))
    rows, shapley = [], Counter()
    for part, own in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[part, f] += len(gone)
                rows.append([part, "".join(order), step, len(left), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def got(df):
    assert df.columns == COLUMNS and dict(df.dtypes)["step"] == "int" and {t for c, t in df.dtypes[3:]} == {"bigint"}
    return sorted(tuple(r) for r in df.collect())


def test_hard_rows_equal_brute_force(spark):
    plain = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t", plain, "same " * 80, "A B C D E F", "a b # c", plain + " $", "UP " * 50 + "*", "\x0bx\x0c y\x85z " * 30, "é" * 200_000 + " " + "x " * 3000]
    docs = [(i % 17 if i % 6 else None, texts[i % len(texts)], [None, "", "a", "b\n"][i % 4]) for i in range(150)]
    labels = [(i % 19, i % 3 % 2, i % 4 % 2) for i in range(25)] + [(None, 1, 1), (3, None, None), (4, 0, 1), (4, 1, 0)]
    d = spark.createDataFrame([(*x, "m", 1, "d") for x in docs], "doc_id long, text string, source string, part string, mask int, digest string")
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(filter_audit.audit(d, m)) == brute(docs, labels)
    assert got(filter_audit.audit(d, m.limit(0))) == brute(docs, [])
    assert got(filter_audit.audit(d.limit(0), m)) == []


def test_query_equals_brute_force_and_sql(spark, sf):
    docs, labels = ([tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(*c).collect()] for n, c in (("documents", ("doc_id", "text", "source")), ("labels", ("doc_id", "quality", "toxic"))))
    found = got(op13_filter_audit(spark, sf))
    assert found == brute(docs, labels)
    con = duckdb.connect()
    for n in ("documents", "labels"):
        con.execute(f"create view {n} as select * from '{sf}/{n}.parquet'")
    assert found == sorted(con.execute(f"select {', '.join(COLUMNS)} from ({filter_audit.SQL})").fetchall())
