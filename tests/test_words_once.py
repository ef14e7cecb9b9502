"""Words are found on the bytes of a batch's texts: the same as tokens(), and no list of words goes to the workers."""

import pyarrow as pa
import pytest

from corpusloom.operators import index, segments

TEXTS = [
    "Red, red_blue x1", "", None, " ", "naïve ÉTÉ Ünïcode", "ΌΔΟΣ ΣΑΣ ς", "İstanbul ẞ ﬁn", "漢字 かな", "étë ́x", "a b c­D", "٣ Ⅷ ½ ²", "𝔘nicode 😀 x", "\x00a\x7fb", "K Å",
    "word", "edge", "tail-", "-head", "1a2B", "don’t", "z" * 300, "� q", "ａＢ１", "ǅ ǆ", "ß_ß", "‍x‌y",
]
SCHEMA = "owner string, key long, title string, body string"
COLUMNS = ["key", "len", "col", "pos", "term"]


def postings(lists):
    return sorted(map(tuple, index.unlisted(lists.filter("term is not null"), "key").select(COLUMNS).collect()))


@pytest.mark.parametrize("stemmed", [False, True])
@pytest.mark.parametrize(("bytes_most", "tokens_most"), [(1 << 20, 1 << 20), (1, 1), (40, 7)])
def test_texts_give_the_words_of_tokens(spark, monkeypatch, stemmed, bytes_most, tokens_most):
    rows = [(f"d{i % 3}", i, a, b) for i, (a, b) in enumerate(zip(TEXTS, TEXTS[3:] + ["running models", "agreed", "hopping"], strict=True))]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    own = index.tokenised(df, ["owner", "key"], ["title", "body"], stemmed)
    want = sorted(map(tuple, index.exploded(own, ["key"]).select(COLUMNS).collect()))
    found = index.texts(df, ["owner", "key"], ["title", "body"]).select("key", "owner", "cols")
    monkeypatch.setattr(index, "BYTES_MOST", bytes_most)
    monkeypatch.setattr(index, "TOKENS_MOST", tokens_most)
    parts = list(index._lists_of_texts(iter(found._collect_as_arrow()), stemmed))
    got = [(k, n, c, p, r["term"]) for part in parts for r in part.to_pylist() if r["term"] is not None for k, n, c, p in zip(r["keys"], r["lens"], r["cols"], r["poss"], strict=True)]
    assert sorted(got) == want
    each = [(o, k, n) for part in parts for r in part.to_pylist() if r["term"] is None for o, k, n in zip(r["owners"], r["keys"], r["lens"], strict=True)]
    assert sorted(each) == sorted(map(tuple, own.select("owner", "key", "len").collect()))
    if bytes_most > 40:
        assert postings(index.listed(index.texts(df, ["owner", "key"], ["title", "body"]), "key", "owner", stemmed)) == want and len(parts) == 1


def test_text_that_is_no_utf8_has_the_words_of_tokens(spark):
    df = spark.range(1).selectExpr("'d' as owner", "id as key", "cast(unhex('6180622063') as string) as title", "cast(unhex('C3') as string) as body")
    own = index.tokenised(df, ["owner", "key"], ["title", "body"])
    assert postings(index.listed(index.texts(df, ["owner", "key"], ["title", "body"]), "key", "owner")) == sorted(map(tuple, index.exploded(own, ["key"]).select(COLUMNS).collect()))


def test_small_batches_share_lists():
    one = lambda key: pa.RecordBatch.from_arrays([pa.array([key]), pa.array(["o"]), pa.array([["red x", "red"]])], ["key", "owner", "cols"])
    (part,) = index._lists_of_texts(iter([one(1), one(2)]), False)
    assert [(r["term"], r["keys"], r["cols"], r["poss"]) for r in part.to_pylist() if r["term"]] == [("red", [1, 1, 2, 2], [0, 1, 0, 1], [0] * 4), ("x", [1, 2], [0, 0], [1, 1])]


def test_an_index_sends_texts_to_the_workers_not_words(spark, tmp_path, monkeypatch):
    sent, real = [], segments.listed
    monkeypatch.setattr(segments, "listed", lambda own, *a: sent.append(own.schema["cols"].dataType.simpleString()) or real(own, *a))
    own = segments.Segments(spark, str(tmp_path / "i"), "key", "owner", ["title", "body"], buckets=4)
    own.rebuild(spark.createDataFrame([("d1", 1, "red", "blue red")], SCHEMA))
    assert sent == ["array<string>"]
