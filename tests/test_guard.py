"""Guarded SQL: nothing is written, no method and no file is in reach."""

import pytest

from corpusloom.plans import guarded


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("guard") / "t")
    spark.range(3).selectExpr("CAST(id AS INT) AS a").write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("r")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW victim USING parquet OPTIONS (path '{path}')")
    return path


@pytest.mark.parametrize("sql", [
    "WITH t AS (SELECT 1 AS a) INSERT INTO victim SELECT a FROM t",
    "FROM r INSERT INTO victim SELECT a INSERT INTO victim SELECT a",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT a FROM r WHERE a IN (SELECT CAST(reflect('java.lang.Integer', 'parseInt', '1') AS INT))",
    "SELECT * FROM parquet.`{path}`",
    "WITH x AS (SELECT * FROM parquet.`{path}`) SELECT * FROM x",
    "SELECT (SELECT max(a) FROM parquet.`{path}`) AS m",
    "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')",
    "SELECT IDENTIFIER('java_' || 'method')('java.lang.System', 'getProperty', 'user.home')",
    "SELECT a FROM r WHERE a IN (SELECT CAST(IDENTIFIER('reflect')('java.lang.Integer', 'parseInt', '1') AS INT))",
    "WITH x AS (SELECT IDENTIFIER('try_' || 'reflect')('java.lang.System', 'getProperty', 'user.home') AS v) SELECT v FROM x",
    "SELECT a FROM IDENTIFIER('r')", "SELECT IDENTIFIER('a') FROM r", "SELECT transform(array(1), x -> IDENTIFIER('java_method')('java.lang.System', 'nanoTime')) AS v",
    "SELECT input_file_name() AS f FROM r", "SELECT (SELECT max(input_file_name()) FROM r) AS f", "SELECT a FROM r ORDER BY input_file_block_start()", "SELECT current_user()", "SELECT current_user", "SELECT user() AS u",
    "SELECT a FROM r GROUP BY a HAVING max(input_file_name()) > ''", "SELECT `java_method`('java.lang.System', 'nanoTime')", "SELECT system.builtin.java_method('java.lang.System', 'nanoTime')",
    "SELECT own_udf(a) FROM r", "SELECT x FROM r LATERAL VIEW own_udf(a) t AS x", "SELECT * FROM python_worker_logs()", "SELECT * FROM nowhere n JOIN parquet.`{path}` p ON true", "SELECT a, max(java_method('java.lang.System', 'nanoTime')) OVER (PARTITION BY a) FROM r",
    "CREATE TABLE z AS SELECT 1", "CACHE TABLE r", "SET a = 1",
])
def test_violations_change_nothing(spark, held, sql):
    spark.udf.register("own_udf", lambda x: x)
    assert guarded.run(spark, sql.format(path=held), most_seconds=60)["status"] == "read_only_violation"
    assert spark.read.parquet(held).count() == 3


@pytest.mark.parametrize("sql", [
    "SELECT a FROM r ORDER BY a", "WITH t AS (SELECT a FROM r) SELECT count(*) AS n FROM t", "SELECT a FROM r WHERE a IN (SELECT max(a) FROM r)",
    "SELECT a, row_number() OVER (ORDER BY a) AS n FROM r UNION ALL SELECT 1, 2", "SELECT a, count(*) AS n FROM r GROUP BY a HAVING count(*) > 0",
    "SELECT * FROM range(5)", "SELECT * FROM explode(array(1, 2))", "SELECT r.a, t.x FROM r, LATERAL (SELECT r.a + 1 AS x) t", "FROM r |> WHERE a > 0 |> SELECT a",
    "SELECT CASE WHEN a BETWEEN 0 AND 1 THEN 'x' ELSE NULL END AS c, -a AS m, a % 2 AS p, a DIV 2 AS q, NOT a > 1 AS n, a <=> 1 AS s FROM r WHERE a IN (0, 1, 2) AND a IS NOT NULL",
    "SELECT transform(array(a), x -> x + 1)[0] AS t, named_struct('k', a).k AS k, cast(a AS string) LIKE '1%' AS l, substring('abc' FROM 2 FOR 1) AS u, trim(BOTH 'x' FROM 'xax') AS v FROM r",
    "SELECT a, sum(a) OVER w AS s, max(a) OVER (ORDER BY a ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS l FROM r WINDOW w AS (PARTITION BY a ORDER BY a DESC NULLS LAST)",
    "SELECT a, count(*) AS n FROM r GROUP BY ROLLUP (a)", "SELECT a, count(*) FILTER (WHERE a > 0) AS n FROM r GROUP BY GROUPING SETS ((a), ())", "SELECT extract(YEAR FROM DATE '2020-01-01') AS y, DATE '2020-01-01' + INTERVAL 1 DAY AS d, current_date() AS c",
    "SELECT * FROM (SELECT a, a % 2 AS p FROM r) PIVOT (count(*) FOR p IN (0, 1))", "SELECT a FROM r WHERE EXISTS (SELECT 1 FROM r s WHERE s.a = r.a + 1) LIMIT 1 OFFSET 1", "SELECT DISTINCT a FROM r EXCEPT SELECT 1 INTERSECT SELECT 1",
    "SELECT explode(array(1, 2)) AS x", "SELECT a, x FROM r LATERAL VIEW explode(array(a)) t AS x", "SELECT count(DISTINCT a) AS n, percentile_approx(a, 0.5) AS p FROM r", "SELECT 'a' ILIKE 'A' AS i, 'a' RLIKE 'a' AS r, a || 'x' AS c FROM r", "SELECT * FROM VALUES (1, 2) AS t(a, b)", "SELECT x.a FROM r x JOIN r y ON x.a = y.a",
])
def test_queries_run(spark, held, sql):
    assert guarded.run(spark, sql, most_seconds=60)["status"] == "ok"


def test_unknown_tables_are_named_by_the_analyser(spark, held):
    found = guarded.run(spark, "SELECT * FROM nowhere JOIN r ON true", most_seconds=60)
    assert found["status"] == "query_failed" and "nowhere" in found["error"]
