"""Pages to chapters against a plain search for the last beginning."""

import random

from corpusloom.operators import books


def test_pages_equal_a_plain_search(spark):
    rng = random.Random(9)
    pages = [(f"b{i % 3}", rng.randrange(-3, 400), f"t{i}") for i in range(300)] + [(None, 5, "x"), ("b0", None, "y"), ("none", 7, "z")]
    chapters = [(f"b{i % 2}", i, f"c{i}", rng.randrange(-2, 420)) for i in range(40)] + [("b0", 90, "twin", 33), ("b0", 91, "twin", 33), (None, 1, "n", 1), ("b1", 2, "n", None), ("empty", 1, "e", 1)]
    p = spark.createDataFrame(pages, "book string, page long, text string")
    c = spark.createDataFrame(chapters, "book string, chapter long, title string, page_start long")
    starts = {}
    for b, n, t, s in sorted(chapters, key=lambda x: -x[1]):
        if b and s is not None:
            starts[b, s] = (n, t)

    def chapter(b, page):
        before = [s for (book, s) in starts if book == b and page is not None and s <= page]
        return starts[b, max(before)] if before else (None, None)

    for block in (1, 7, 64):
        got = sorted(map(tuple, books.page_chapters(p, c, block).collect()), key=repr)
        assert got == sorted(((*r, *chapter(r[0], r[1])) for r in pages), key=repr)
    assert books.page_chapters(p.limit(0), c).count() == 0 and books.page_chapters(p, c.limit(0)).filter("chapter is null").count() == len(pages)


def test_a_bad_chapter_does_not_abort_the_book(spark):
    pages = spark.createDataFrame([("b", 1, "word " * 50), ("b", 2, "more " * 50), ("b", 3, "short"), ("b", 4, "tail " * 50), ("b", 5, None)], "book string, page long, text string")
    chapters = spark.createDataFrame([("b", 1, "The First Part", 1), ("b", 2, "Short", 3), ("b", 100, "Far", 4)], "book string, chapter long, title string, page_start long")
    got = {r["chapter"]: (r["slug"], r["n_pages"], r["error"]) for r in books.chapter_sources(pages, chapters).collect()}
    assert got == {1: ("b__ch01_first_part", 2, None), 2: ("b__ch02_short", 1, "too little text"), 100: (None, 2, "no slug for this number")}
