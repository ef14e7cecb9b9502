"""Staged files of other formats: taxonomy JSON, anthology MODS records, notebooks, post references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.ids import MENTION

TAXONOMY = "struct<domains:array<struct<name:string,description:string,collections:array<struct<name:string,description:string>>>>>"


def taxonomy(df: DataFrame, column: str) -> DataFrame:
    """domain, collection, description of a taxonomy's JSON text; a domain without collections has one row with a null collection."""
    d = df.select(F.explode(F.from_json(column, TAXONOMY)["domains"]).alias("d"))
    return d.select(F.col("d.name").alias("domain"), F.explode_outer("d.collections").alias("c")).select("domain", F.col("c.name").alias("collection"), F.col("c.description").alias("description"))


def mods(xml: Column) -> Column:
    """struct<title, authors, date> of a MODS record: title with subtitle, personal names that aren't editors, the year's first of January; null without a year."""
    at = "//*[local-name()='mods'][1]"
    text = lambda p: F.trim(F.xpath_string(xml, F.lit(p)))
    title = text(f"{at}/*[local-name()='titleInfo']/*[local-name()='title']")
    sub = text(f"{at}/*[local-name()='titleInfo']/*[local-name()='subTitle']")
    person = f"{at}/*[local-name()='name'][@type='personal'][not(.//*[local-name()='roleTerm']='editor')]"
    given, family = (F.xpath(xml, F.lit(f"{person}/*[local-name()='namePart'][@type='{t}'][1]/text()")) for t in ("given", "family"))
    plain = F.xpath(xml, F.lit(f"{person}/*[local-name()='namePart'][not(@type)]/text()"))
    year = F.regexp_extract(text(f"{at}//*[local-name()='dateIssued']"), r"(\d{4})", 1)
    authors = F.concat(F.zip_with(given, family, lambda g, f: F.trim(F.concat_ws(" ", g, f))), plain)
    return F.when(year != "", F.struct(F.when(sub != "", F.concat_ws(": ", title, sub)).otherwise(title).alias("title"), authors.alias("authors"), F.concat(year, F.lit("-01-01")).alias("date")))


def notebook(content: Column) -> Column:
    """A notebook's code and markdown cells as text, each behind a `# %%` mark, outputs left out; null for what is no notebook."""
    cells = F.from_json(content, "struct<cells:array<struct<cell_type:string,source:string>>>")["cells"]
    lines = lambda s: F.coalesce(F.array_join(F.from_json(s, "array<string>"), ""), s)
    own = F.filter(cells, lambda c: c["cell_type"].isin("code", "markdown"))
    shown = F.transform(own, lambda c: F.concat(F.when(c["cell_type"] == "code", "# %%\n").otherwise("# %% [markdown]\n"), F.when(F.substring(c["source"], 1, 1) == "[", lines(c["source"])).otherwise(c["source"])))
    return F.array_join(shown, "\n\n")


def post_references(posts: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, cited, context: preprints a post mentions, each once, at its first place, with 40 characters before and 200 behind."""
    found = posts.select(key, text, F.posexplode(F.regexp_extract_all(text, F.lit(f"({MENTION})"), F.lit(1))).alias("ord", "said"))
    old, new, url = (F.regexp_extract("said", MENTION, i) for i in (1, 2, 3))
    cited = F.when(old != "", F.lower(old)).when(new != "", new).otherwise(url)
    first = Window.partitionBy(key, "cited").orderBy("ord")
    at = F.expr(f"instr({text}, said)")
    context = F.trim(F.regexp_replace(F.col(text).substr(F.greatest(at - 40, F.lit(1)).cast("int"), F.lit(240)), r"\s+", " "))
    return found.withColumn("cited", cited).withColumn("n", F.row_number().over(first)).filter("n = 1").select(key, "ord", "cited", context.alias("context"))
