import zlib

import numpy as np

from corpusloom.llm.langid import BITS, EDGES, _BLANK, fit, held_out, kernel, predict, presence, train

TEXTS = {"aa": ["the cat and the dog went to that house", "they that think there is the other thing"], "bb": ["der hund und die katze gehen nach haus", "ich denke dass es eine andere sache ist"]}


def plain_presence(text):
    data = [int(_BLANK[b]) for b in text.lower().encode()]
    out = set()
    for k, bits in enumerate(BITS):
        for i in range(len(data) - k):
            gram = int.from_bytes(bytes(data[i : i + k + 1]), "big")
            out.add(int(EDGES[k]) + (gram if k == 0 else (gram * 2654435761 % (1 << 32)) >> (32 - bits)))
    return out


def test_presence_and_kernel_follow_the_definition():
    texts = ["", "a", "Hé 12!", "the cat", "x" * 300 + "ÀÉ"]
    got = presence(texts)
    assert [set(np.flatnonzero(r).tolist()) for r in got] == [plain_presence(t) for t in texts]
    k = kernel(got, got)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y, total = plain_presence(a), plain_presence(b), 0
            for lo, hi in zip(EDGES, EDGES[1:], strict=False):
                p, q = ({g for g in s if lo <= g < hi} for s in (x, y))
                total += len(p & q) / (max(1, len(p)) * max(1, len(q))) ** 0.5
            assert abs(k[i, j] - total / 3) < 1e-5


def test_fit_separates():
    texts = [t for own in TEXTS.values() for t in own] * 3
    labels = [lang for lang, own in TEXTS.items() for _ in own] * 3
    model = fit(presence(texts), labels, n_landmarks=4)
    assert [model.languages[i] for i in model.scores(["the other house", "die andere katze"]).argmax(1)] == ["aa", "bb"]


def test_hard_rows(spark):
    rows = [(i, t, lang, 5) for lang, own in TEXTS.items() for i, t in enumerate(own * 20, 0 if lang == "aa" else 100)]
    rows += [(900, None, "aa", 1), (901, "", None, 1), (902, "123 !? ", "bb", 1), (None, "der hund", "bb", 1), (903, "Ж", None, 1), (904, "die katze " * 30_000, None, 1), (905, "½ ²", "aa", 1), (0, TEXTS["aa"][0], "aa", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = [tuple(r) for r in predict(df, train(df)).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r[1:] for r in got}
    assert all(by[i] == ("und", 0.0) for i in (900, 901, 902, 905))
    assert by[904][0] == "bb" and by[None][0] == "bb" and by[903][0] in ("aa", "bb")
    assert all(0 <= r[2] <= 1 for r in got)
    assert sum(by[i][0] == "bb" for i in range(100, 140)) == 40
    none = df.filter("doc_id > 1000")
    assert train(none) is None and predict(none, None).count() == 0
    assert predict(df.limit(3), None).filter("lang_pred = 'und'").count() == 3
    flags = {r[0]: r[1] for r in df.select("doc_id", held_out("doc_id")).collect()}
    assert all(f == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, f in flags.items())


def test_held_out_accuracy(spark):
    from corpusloom.llm.queries import op7_language_id

    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert held and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.98


def test_repeats_of_an_id_count_once(spark):
    texts = [(i, t, lang) for lang, own in TEXTS.items() for i, t in enumerate(own * 3, 0 if lang == "aa" else 100)]
    hot = [(7, TEXTS["aa"][0], "aa")] * 3000
    model = train(spark.createDataFrame(texts + hot, "doc_id long, text string, lang string"), per_language=3, n_landmarks=50)
    assert len(model.landmarks) <= 6 and model.languages == ["aa", "bb"]
