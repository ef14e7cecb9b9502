"""Windows and brackets of snippets against a plain search of all windows."""

import random
import re
import unicodedata

from corpusloom.operators import index, search, snippets
from corpusloom.plans.parser import parse, phrases


def fold(word):
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).lower()


def brute(text, wanted, width):
    found = list(re.finditer(r"[^\W_](?:[^\W_]|[̀-ͯ])*", text))
    words = [fold(m[0]) for m in found]
    spots = []
    for k, p in enumerate(wanted):
        for i in range(len(words) - len(p.tokens) + 1):
            own = words[i : i + len(p.tokens)]
            if own[:-1] == list(p.tokens[:-1]) and (own[-1].startswith(p.tokens[-1]) if p.prefix else own[-1] == p.tokens[-1]):
                spots.append((k, i, i + len(p.tokens)))
    best = None
    for start in sorted({s for _, s, _ in spots}):
        held = [x for x in spots if start <= x[1] < start + width and (x[2] <= start + width or x[1] == start)]
        spans = sorted({x[1:] for x in held})
        rank = (-len({x[0] for x in held}), -len(spans), start)
        best = min(best or (rank, spans), (rank, spans))
    start, spans = (best[0][2], best[1]) if best else (0, [])
    start = max(0, min(start, len(words) - width))
    stop = min(len(words), start + width)
    opens = {s for s, _ in spans if not any(a < s < b for a, b in spans)}
    closes = {e for _, e in spans if not any(a < e < b for a, b in spans)}
    out = "…" if start else ""
    for i in range(start, stop):
        out += "[" * (i in opens) + found[i][0] + "]" * (i + 1 in closes) + (text[found[i].end() : found[i + 1].start()] if i + 1 < stop else "")
    return (start if best else None), len(spans) if best else None, (out + "…" * (stop < len(words)) if words else None)


def test_windows_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["red", "Green", "blue", "naïve", "naïve", "data", "database", "x", "—", "(y)"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", " - ", None, "red " * 30, "only here", "red green red green blue red"]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, body string").selectExpr("key", "'red' AS title", "body")
    own = index.build(rows, "key", ["title", "body"])
    for query, width in (('red OR "green blue" OR data*', 6), ("naive OR \"red green\" OR \"green red\"", 8), ('"red green blue" OR red', 2), ("data*", 64)):
        node = parse(query).node
        hits = search.page(index.bm25(own, node), "key", 100)
        got = {r["key"]: (r["snip_start"], r["n_spans"], r["snippet"]) for r in snippets.snippets(own, rows, node, hits, "body", 1, width).collect()}
        assert len(got) == hits.count() > 10
        for key, found in got.items():
            assert found == brute(texts[key] or "", list(dict.fromkeys(phrases(node))), width), (query, texts[key])
