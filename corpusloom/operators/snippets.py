"""Snippets: of each hit the window of tokens that holds most distinct phrases of the query, cut from its text with the phrases in brackets.

Windows are chosen on the postings' positions, by a range frame over the places of one row's column. Only the texts of the hits that are shown are read
and split again, to find where those tokens stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.index import Index, places
from corpusloom.plans.parser import Node, phrases

WIDTH, WIDE = 64, 256
#: A token as it stands in a text, its combining marks included; folded, it is the index's term.
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*"


def windows(index: Index, query: Node, keys: DataFrame, column: int, width: int = WIDTH) -> DataFrame:
    """key, start (token, from 0), n_phrases, n_spans, spans: the best window of `width` tokens of each row in keys that holds a phrase in that column.

    A window begins where a phrase does. Best is most distinct phrases, then most places, then the earliest. A phrase longer than the window is no place
    in it, unless it begins it. spans: (first, last + 1) tokens of the places within.
    """
    key = index.key
    found = places(index, list(dict.fromkeys(phrases(query)))).filter(F.col("col") == column).join(keys.select(key).distinct(), key, "left_semi")
    near = Window.partitionBy(key).orderBy("start").rangeBetween(0, width - 1)
    held = found.withColumn("all", F.collect_list(F.struct("k", "start", (F.col("start") + F.col("n").cast("int")).alias("stop"))).over(near))
    inside = held.withColumn("held", F.filter("all", lambda x: (x["stop"] <= F.col("start") + width) | (x["start"] == F.col("start"))))
    counted = inside.select(key, "start", F.size(F.array_distinct(F.transform("held", lambda x: x["k"]))).alias("n_phrases"), F.array_distinct(F.transform("held", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))).alias("spans"))
    best = F.max(F.struct("n_phrases", F.size("spans").alias("n_spans"), (-F.col("start")).alias("at"), "spans"))
    return counted.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.at")).alias("start"), "b.n_phrases", "b.n_spans", F.array_sort("b.spans").alias("spans"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def begin(text: Column, start: Column, width: int) -> Column:
    """Where a window is shown from: earlier than its first phrase where the text ends before the window does. No other phrase comes in, or the best window had begun there."""
    return F.greatest(F.lit(0), F.least(start, F.size(words_of(text)) - width))


def cut(text: Column, start: Column, spans: Column, width: int = WIDTH) -> Column:
    """The window's text as it stands, `[` and `]` around its places (overlapping ones share a pair), an ellipsis where the text goes on."""
    words, between = words_of(text), F.split(text, TOKEN)
    stop = F.least(F.size(words), start + width)
    opens = F.filter(spans, lambda a: ~F.exists(spans, lambda b: (b["start"] < a["start"]) & (a["start"] < b["stop"])))
    closes = F.filter(spans, lambda a: ~F.exists(spans, lambda b: (b["start"] < a["stop"]) & (a["stop"] < b["stop"])))

    def said(i: Column) -> Column:
        return F.concat(
            F.when(F.exists(opens, lambda s: s["start"] == i), "[").otherwise(""), F.get(words, i),
            F.when(F.exists(closes, lambda s: s["stop"] == i + 1), "]").otherwise(""), F.when(i + 1 < stop, F.get(between, i + 1)).otherwise(""),
        )

    inner = F.array_join(F.transform(F.sequence(start, F.greatest(start, stop - 1)), said), "")
    return F.when(F.size(words) > start, F.concat(F.when(start > 0, "…").otherwise(""), inner, F.when(stop < F.size(words), "…").otherwise("")))


def snippets(index: Index, rows: DataFrame, query: Node, hits: DataFrame, column: str, number: int, width: int = WIDTH) -> DataFrame:
    """hits (a page, with the index's key) with snip_start, n_phrases, n_spans and snippet of a text column, the index's `number`-th.

    Hits whose phrases stand in other columns alone have the text's beginning and no brackets; those without a text or a word, null. rows: key and the column.
    """
    key = index.key
    found = windows(index, query, hits, number, width)
    own = hits.join(found.withColumnRenamed("start", "snip_start"), key, "left").join(rows.select(key, F.col(column).alias("__text")), key, "left")
    none = F.lit([]).cast("array<struct<start:int,stop:int>>")
    own = own.withColumn("snip_start", F.when(F.col("snip_start").isNotNull(), begin(F.col("__text"), F.col("snip_start"), width)))
    return own.withColumn("snippet", cut(F.col("__text"), F.coalesce("snip_start", F.lit(0)), F.coalesce("spans", none), width)).drop("__text", "spans")
