import corpus_pipeline
from corpusloom.llm.langid import has_letter
from test_decontam import needed, plain_best, plain_words
from test_near_dedup import plain_set
from test_packing import check_packed
from test_secrets import ORDER, plain
from test_simhash import roots


def redacted(text):
    order = {k: i for i, k in enumerate(ORDER)}
    spans = [(s, e) for s, _, e in sorted((int(s.split(":")[1]), order[s.split(":")[0]], int(s.split(":")[2])) for s in plain(text)[2].split(",") if s)]
    out, at = "", 0
    for s, e in spans:
        if e > at:
            out += "" if s < at else text[at:s] + "[SECRET]"
            at = max(at, e)
    return out + text[at:] if spans else text


def brute_force(docs, items):
    docs = [(i, t) for i, t in docs if has_letter(t)]
    sets = [plain_set(t) for _, t in docs]  # the stage's rule: 5-word shingles, Jaccard similarity 0.8 or more
    own = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    least = {}
    for (i, _), r in zip(docs, own, strict=True):
        least[r] = min(least.get(r, i), i)
    docs = [(i, t) for (i, t), r in zip(docs, own, strict=True) if least[r] == i]
    clean = []
    for i, t in docs:
        said = plain_words(t)
        known = set(said)
        if not any(sum(w in known for w in item) >= needed(len(item)) and plain_best(said, item) >= needed(len(item)) for item in items):
            clean.append((i, redacted(t)))
    return dict(clean)


def test_run_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    check_packed(corpus_pipeline.run(spark, sf).collect(), brute_force(docs, items), 1024)


def test_stages_keep_columns_and_stand_hard_rows(spark, sf):
    rows = [(1, "hello there world again and again", "en", "s", 9), (2, "hello there world again and again", "en", "s", 9), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "12 34", "en", "s", 5), (6, 'user: bob password = "abcdefgh"', "en", "s", 31), (7, "w" * 70_000, "en", "s", 70_000), (7, "w" * 70_000, "en", "s", 70_000), (None, "no id here at all", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        df = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf)
            assert df.columns == docs.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, df, sf).collect()
        kept = {r["doc_id"]: r["text"] for r in df.collect()}
        if start is docs:
            assert kept.keys() == {1, 6, 7, None}
            assert kept[6] == '[SECRET] [SECRET]"' and {r["doc_id"] for r in out} == kept.keys()
            assert {r["doc_id"]: r["n_chars"] for r in df.collect()}[6] == len(kept[6])
        else:
            assert not out
