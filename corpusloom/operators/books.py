"""Books as chapters: each page goes to the last chapter that begins at or before it, and each chapter is a source of its own.

The as-of join is an equi-join on blocks of pages: a chapter stands for every block that it reaches into, so a page meets the few chapters of its block, however many pages a book has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import ids

BLOCK = 64


def spans(chapters: DataFrame, last_pages: DataFrame) -> DataFrame:
    """book, chapter, title, first, last: where chapters (book, chapter, title, page_start) begin and end; the last of a book ends with its pages (book, last_page).

    Of chapters that begin on one page the first stands; those without a book or a page are left out, as are those behind the book's last page.
    """
    own = chapters.filter("book is not null and page_start is not null").withColumn("n", F.row_number().over(Window.partitionBy("book", "page_start").orderBy("chapter"))).filter("n = 1")
    following = F.lead("page_start").over(Window.partitionBy("book").orderBy("page_start"))  # chapters of one book
    ended = own.withColumn("next", following).join(last_pages, "book")
    return ended.select("book", "chapter", "title", F.col("page_start").alias("first"), F.least(F.coalesce(F.col("next") - 1, F.col("last_page")), F.col("last_page")).alias("last")).filter("first <= last")


def page_chapters(pages: DataFrame, chapters: DataFrame, block: int = BLOCK) -> DataFrame:
    """pages (book, page, ...) with chapter and title, null for pages before the first chapter, of books without any, or without a book or number. Repeated pages stay."""
    last = pages.groupBy("book").agg(F.max("page").alias("last_page")).filter("book is not null and last_page is not null")
    at = lambda p: F.floor(F.col(p) / block)
    held = spans(chapters, last).withColumn("block", F.explode(F.sequence(at("first"), at("last")))).withColumnRenamed("book", "of")
    met = (F.col("book") == F.col("of")) & (F.col("page_block") == F.col("block")) & F.col("page").between(F.col("first"), F.col("last"))
    return pages.withColumn("page_block", at("page")).join(held, met, "left").select(*pages.columns, "chapter", "title")


def chapter_sources(pages: DataFrame, chapters: DataFrame, least: int = 200) -> DataFrame:
    """book, chapter, slug, title, n_pages, markdown, error: a source for each chapter with pages, its texts (column text) in page order.

    A chapter whose text is shorter than `least` or whose number has no slug (1 to 99) has an error and no markdown; the others of its book are not touched.
    """
    held = page_chapters(pages, chapters).filter("chapter is not null")
    own = held.groupBy("book", "chapter", "title").agg(F.countDistinct("page").alias("n_pages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), "\n").alias("said"))
    slug = ids.chapter_slug(F.col("book"), F.col("chapter"), F.coalesce("title", F.lit("")))
    error = F.when(slug.isNull(), "no slug for this number").when(F.length(F.trim("said")) < least, "too little text")
    return own.select("book", "chapter", slug.alias("slug"), "title", "n_pages", F.when(error.isNull(), F.col("said")).alias("markdown"), error.alias("error"))
