"""overlapping_chunks and its SQL on texts that are null, empty or blank, or have white space of any kind at their ends."""

import duckdb

from corpusloom.queries import QUERIES, SQL


def test_chunks_of_odd_texts_equal_their_sql(spark, tmp_path):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    texts = [None, "", " ", "\n", "a", " \n a b \n ", "\u3000a\u00a0b\u00a0 ", "\u2003\t \u2003x\u180e", "a\x0bb\x1cc\x85d\x00e", "\ufeff a\u200b ", "é\U0001f600\u3000\u3000", words(350), words(351), words(350) + "\n", "\r\n" + words(700) + "\t"]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([*enumerate(texts), (None, "q"), (4, "again")], "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    columns = ["doc_id", "chunk", "n_tokens", "digest"]
    got = QUERIES["overlapping_chunks"](spark, str(tmp_path)).select(*columns).collect()
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL['overlapping_chunks']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
