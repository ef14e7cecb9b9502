"""Ingest stages: fallback, errors by row, resuming, forced reruns."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import html
from corpusloom.streaming import stages

LONG = "# Title\n" + "Some words about Dense Passage Retrieval (DPR) here. " * 6 + "\n## Empty\n## End\nlast"


def rows(df):
    return {r["id"]: r for r in df.collect()}


def made(spark, tmp_path, convert=None):
    return stages.Ingest(stages.create(spark, str(tmp_path / "s"), 2), stages.section_index(spark, str(tmp_path / "i"), 2), convert or (lambda b: F.struct(b.alias("markdown"), F.lit(None).cast("string").alias("error"))), "2026-01-01")


def given(spark, ids):
    requests = spark.createDataFrame([(i, "Dense: search", "2020-01-01", f"2001.{i:05d}v1") for i in ids] + [(None, "x", "2020-01-01", "1")], "id long, title string, published string, raw_id string")
    page = ("text/html", "https://x.org/html/1")
    answers = [(1, "html", 200, *page, LONG), (1, "mirror", 200, *page, "never"), (2, "html", 404, *page, LONG), (2, "mirror", 200, *page, LONG + " 2"), (3, "html", 200, "application/json", page[1], LONG), (3, "latex", 200, "x", "y", LONG + " 3"), (4, "html", 200, *page, f"<b>{stages.FATAL.upper()}</b>"), (4, "mirror", 200, page[0], "https://x.org/abs/1", LONG), (4, "pdf", 200, "x", "y", " "), (5, "html", 200, *page, "short"), (6, "html", 200, *page, "BAD" + LONG), (7, "html", 200, *page, LONG), (None, "html", 200, *page, LONG)]
    fetched = spark.createDataFrame(answers, "id long, tier string, code int, content_type string, url string, body string")
    decisions = spark.createDataFrame([(i, "d", "c", True, i == 2) for i in (1, 2, 3, 6)] + [(1, "d", "c2", False, False)], "id long, domain string, collection string, is_primary boolean, needs_review boolean")
    return requests, fetched, decisions


def test_all_stages_with_errors_by_row(spark, tmp_path):
    @F.udf("struct<markdown:string,error:string>")
    def convert(body):
        return (None, "ValueError: bad") if body.startswith("BAD") else (body, None)

    own = made(spark, tmp_path, convert)
    got = rows(own.run(*given(spark, range(1, 9))))
    assert {i: (r["status"], r["tier"]) for i, r in got.items()} == {1: ("indexed", "html"), 2: ("indexed", "mirror"), 3: ("indexed", "latex"), 4: ("failed_html", None), 5: ("failed_parse", "html"), 6: ("fetched", "html"), 7: ("converted", "html"), 8: ("failed_html", None)}
    assert got[6]["error"] == "ValueError: bad" and got[6]["needs_review"] and got[2]["needs_review"] and not got[1]["needs_review"]
    assert got[1]["slug"] == "dense_2020" and got[2]["slug"] == "dense_2020_00002" and len({r["slug"] for r in got.values()}) == 8
    assert (got[1]["n_terms"], got[1]["n_sections"]) == (1, 2), "the section without a body is left out"
    assert sorted((r["id"], r["collection"]) for r in own.store.read("members").collect()) == [(1, "c"), (1, "c2"), (2, "c"), (3, "c")]
    assert own.index.rows().count() == own.store.read("sections").count() == 6
    totals = {r["status"]: r["sources"] for r in own.totals().collect()}
    assert totals == {"indexed": 3, "failed_html": 2, "failed_parse": 1, "fetched": 1, "converted": 1}


def test_a_stopped_run_goes_on_and_a_repeated_one_changes_nothing(spark, tmp_path, monkeypatch):
    own, args = made(spark, tmp_path), given(spark, (1, 2))
    own.run(*args, stop_after="converted")
    assert {r["status"] for r in own.summary().collect()} == {"converted"}
    real = own.store.replace
    monkeypatch.setattr(own.store, "replace", lambda changes: (_ for _ in ()).throw(OSError("lost")) if "sections" in changes else real(changes))
    with pytest.raises(OSError):
        own.run(*args)  # the index has the sections, the store doesn't know yet
    assert {r["status"] for r in own.summary().collect()} == {"extracted"}
    monkeypatch.setattr(own.store, "replace", real)
    first = rows(own.run(*args))
    assert {r["status"] for r in first.values()} == {"indexed"} and own.index.rows().count() == 4 and own.index.manifest().rows == 4
    version = own.store.snapshot()["version"]
    assert rows(own.run(*args)) == first and own.index.rows().count() == 4
    assert own.store.snapshot()["version"] == version, "nothing to do is no commit"


def test_force_keeps_slug_and_first_date(spark, tmp_path):
    own, args = made(spark, tmp_path), given(spark, (1, 2))
    before = rows(own.run(*args))
    own.as_of = "2027-01-01"
    assert own.force(spark.createDataFrame([(2,), (99,)], "id long")) == 1 and own.force(spark.createDataFrame([], "id long")) == 0
    assert rows(own.summary())[2]["status"] is None and own.index.rows().count() == 2 and own.store.read("members").filter("id = 2").count() == 0
    assert rows(own.run(*args)) == before and own.index.rows().count() == 4


def test_a_bad_page_does_not_stop_the_others(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "<p>ok</p>"), (2, "<p>" * 5000 + "deep"), (3, None)], "id int, html string")
    got = rows(pages.select("id", html.converted(F.col("html"), F.lit("https://x.org")).alias("c")).select("id", "c.markdown", "c.error"))
    assert got[1]["markdown"] == "ok\n" and got[1]["error"] is None and got[3]["markdown"] is None and got[3]["error"] is None
    assert (got[2]["error"] is None) == (got[2]["markdown"] is not None)
