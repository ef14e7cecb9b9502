from corpusloom.llm.queries import op9_license_scan


def test_query_returns_every_classified_row(spark, tmp_path):
    lines = ["License: MIT", "BSD 2-Clause License", "Licensed under GPLv2", "Released under the MIT License", "She renewed her driving license last week"]
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op9_license_scan(spark, str(tmp_path)).collect()}
    assert got.keys() == set(range(len(lines)))
    assert got[3]["confirmed"] and got[3]["family"] == "mit"
    assert [got[i]["family"] for i in range(5)] == ["mit", "bsd", "gpl", "mit", "unknown"]
