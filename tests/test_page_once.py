"""A page of hits is worked out once, however many reads hang on it."""

from pyspark.sql import functions as F

from corpusloom.operators import enrich


def test_hits_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(i):
        seen.add(1)
        return i

    hits = spark.range(3).select(F.udf(counted, "long")("id").alias("id"))
    none = spark.createDataFrame([], "id long, topic string, term_id long, term_type string, entity_type string, canonical_name string, number long, caption string, slug string, url string")
    rows = enrich.enrich(hits, "id", none.select("id", "topic"), none.select("id", "term_id"), none.select("term_id", "term_type", "entity_type", "canonical_name"), none.select("id", "number", "caption"), none.select("id", "slug", "url")).collect()
    assert sorted(r["id"] for r in rows) == [0, 1, 2] and seen.value == 3
