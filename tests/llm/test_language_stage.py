import zlib

import corpus_pipeline
from corpusloom.llm.langid import train


def test_stage_without_a_usable_label(spark, sf):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for lang, ids in ((None, range(20)), ("en", held)):
        rows = [(i, f"some text {i}", lang, "s", 9) for i in ids]
        bad = [(held[0], None, lang, "s", 0), (held[0], "12 34 !", lang, "s", 7), (held[0], "", lang, "s", 0)]
        docs = spark.createDataFrame([*rows, *bad], schema)
        assert train(docs) is None
        got = corpus_pipeline.language_id(spark, docs, sf)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(rows, key=lambda r: r[0])
