"""Small literal tables of hard cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLES: dict[str, tuple[str, list[tuple]]] = {
    "lit_terms": (
        "term_id long, domain string, term_type string, canonical_name string",
        [(1, "rag", "entity", "ColBERT"), (2, "rag", "entity", "Dense Passage Retrieval"), (3, "rag", "topic", "query expansion"), (4, "vision", "entity", "Vision Transformer model"), (5, "vision", "entity", "ColBERT"), (6, "rag", "entity", "BM-25 method"), (7, "rag", "entity", "HotpotQA dataset"), (8, "rag", "topic", "rérank system system")],
    ),
    "lit_aliases": ("term_id long, alias string", [(2, "DPR framework"), (4, "ViT"), (7, "hotpot-QA"), (1, "col bert v1")]),
    "lit_names": (
        "raw string, domain string, term_type string",
        [("ColBERT", "rag", "entity"), ("colbert!", "rag", "entity"), ("dpr", "rag", "entity"), ("bm 25", "rag", "entity"), ("vision  transformer", "vision", "entity"), ("ColBERT", "vision", "topic"), ("Hotpot QA", "rag", "entity"), ("Query-Expansion approach", "rag", "topic"), ("nothing", "rag", "topic"), ("hotpotqa benchmark", "rag", "entity"), ("vit", "vision", "entity")],
    ),
    "lit_ids": (
        "raw string",
        [("https://arxiv.org/abs/2301.12345v2",), ("http://arxiv.org/pdf/2301.12345.pdf",), ("cs/0701006",), ("2301.123",), ("2021.acl-long.285",), ("https://aclanthology.org/P19-1001.pdf",), ("www.aclanthology.org/2021.acl-long.285/",), ("https://github.com/Some-Owner/Repo.git",), ("https://www.gitlab.com/a/b/",), ("https://github.com/a/b/issues/4",), ("https://github.com/a",), ("https://example.com/a/b",), ("see (https://bitbucket.org/x/y).",), ("https://bitbucket.org/x/y).",), ("  2310.08560v1 ",), ("",), ("https://arxiv.org/html/2301.12345/2301.12345v1/x1.png",), ("https://arxiv.org/html/2301.12345v3/latex/fig.png",)],
    ),
    "lit_refs": (
        "src long, ref_number long, raw_text string",
        [(1, 1, "Smith et al. arXiv:2310.08560v3, 2023"), (1, 2, "ARXIV: cs/0701006"), (1, 3, "Lee, https://arxiv.org/abs/2401.00001v2"), (1, 4, "No id here"), (2, 1, "arXiv: 2310.085 too short"), (2, 2, "two: arXiv:2310.08560 and arXiv:2401.00001"), (2, 3, "www.arxiv.org/abs/1234.5678"), (3, 1, "arXiv:Hep-TH/9901001"), (3, 2, "")],
    ),
    "lit_titles": (
        "title string, date string, id string",
        [("ColBERT: Efficient Passage Search", "2020-04-27", "2004.12832v2"), ("Attention Is All You Need", "2017-06-12", "1706.03762"), ("The of and", "2021-01-01", "2101.00001"), ("Ünïcode Größe: x", "2022-02-02", "2202.00002"), ("日本語", "2023-03-03", "2303.00003v1"), ("A Survey on Large Language Models", "2023-01-01", "2301.00009"), ("survey: of large", "2023-05-05", "acl:P19-1001")],
    ),
    "lit_domains": ("name string", [("Machine Learning / NLP",), ("  --Weird__",), ("x" * 80,), ("Émile & co.",), ("a/b c\td",), ("",)]),
    "lit_headings": ("title string", [("4.1.2 Results:",), ("**Bold  Title**",), ("*it*",), ("plain",), ("12. Intro",), ("__Under__",), ("Ends :",)]),
    "lit_spans": (
        "doc long, start long, norm string, label string, score double, ord long",
        [(1, 0, "bert", "model", 0.9, 1), (1, 0, "bert", "method", 0.9, 2), (1, 0, "bert", "dataset", 0.3, 3), (1, 9, "squad", "dataset", 0.5, 4), (1, 9, "squad", "model", 0.7, 5), (2, 3, "bert", "method", 0.4, 6), (2, 8, "bert", "method", 0.6, 7), (3, 1, "squad", "dataset", 0.8, 8), (3, 4, "glue", "metric", 0.44, 9), (3, 7, "glue", "dataset", 0.46, 10), (4, 0, "squad", "dataset", 0.81, 11)],
    ),
    "lit_evidence": (
        "term long, ord long, label string, score double",
        [(1, 1, "A", 0.5), (1, 2, "A", 0.9), (1, 3, "B", 0.6), (2, 1, "A", 0.5), (2, 2, "B", 0.5), (2, 3, "", 0.9), (3, 1, "A", 0.2), (3, 2, "B", 0.3), (3, 3, "A", 0.4), (3, 4, "C", 0.35)],
    ),
    "lit_entities": (
        "name string",
        [("BERT",), ("",), ("  ",), ("a\nb",), ("42",), ("NV-",), ("+5.6%",), ("-x",), ("x" * 101,), ("Table 2",), ("Fig. 3a",), ("Table two three",), ("10.9 ms",), ("209 docs",), ("10K",), ("Vector",), ("json",), ("Dataset",), ("dataset model",), ("QA",), ("qa",), ("ab",), ("GPT-4",), ("3D scene!",), ("Section 4.1",)],
    ),
    "lit_files": (
        "repo string, path string, size long, content string",
        [("r1", "README.md", 10, "hi"), ("r1", "readme", 10, "hi"), ("r1", "src/main.py", 100, "print(1)\n"), ("r1", "node_modules/x.js", 9, "x"), ("r1", "a.egg-info/PKG", 9, "x"), ("r1", "img/logo.PNG", 9, "x"), ("r1", "package-lock.json", 9, "{}"), ("r1", "data/big.json", 50_001, "{}"), ("r1", "data/ok.json", 50_000, "{}"), ("r1", "huge.py", 1_000_001, "x"), ("r1", "app.js", 500, "x" * 300), ("r1", "ok.js", 500, "a\n" * 40), ("r1", "style.css", 500, ("y" * 111 + "\n") * 3), ("r1", "Dockerfile", 5, "FROM x"), ("r1", "runs/events.out.tfevents.123", 5, "x"), ("r1", "docs/README.rst", 5, "x"), ("r2", "ReadMe.RST", 5, "x"), ("r2", "README.txt", 5, "x"), ("r2", "lib/Makefile", 5, "x"), ("r2", "bad.py", 50, "�" + "a" * 40), ("r2", "fine.py", 200, "�" + "a" * 150), ("r2", ".gitignore", 3, "x"), ("r2", "build/out.py", 3, "x"), ("r2", "builds/out.py", 3, "x"), ("r2", "a.ipynb", 3, "{}")],
    ),
    "lit_outline": (
        "book string, ord long, level long, title string, page long, pages long",
        [("b1", 1, 1, "One", 1, 90), ("b1", 2, 1, "Two ", 10, 90), ("b1", 3, 2, "Two.a", 12, 90), ("b1", 4, 1, "Three", 30, 90), ("b2", 1, 1, "Part I", 1, 50), ("b2", 2, 2, "A", 2, 50), ("b2", 3, 2, "B", 9, 50), ("b2", 4, 1, "Part II", 20, 50), ("b2", 5, 2, "C", 21, 50), ("b2", 6, 2, "C again", 21, 50), ("b3", 1, 1, "X", 5, 9), ("b3", 2, 1, "Y", 3, 9), ("b4", 1, 1, "only", 1, 9), ("b5", 1, 1, "P", 1, 40), ("b5", 2, 1, "Q", 20, 40), ("b5", 3, 2, "q1", -1, 40)],
    ),
    "lit_markdown": (
        "slug string, md string",
        [
            ("m1", "Before all.\n\n# Top\nintro\n## Setup\nfirst\n```python\n# not a header\n```\n### Deep *x*\ndeep text\n# Other\n## Setup\nsecond\n"),
            ("m2", "# A\n~~~\n# inside\n```\n# outside again\n#### four stays\ntext\n## 2.1 **Bold**:  \nbody"),
            ("m3", "no headers at all"),
            ("m4", "   \n## Only\n### Empty\n### Full\nx\n\ny"),
            ("m5", ""),
        ],
    ),
    "lit_events": ("kind string, id long, status string, target string", [("paper", 1, None, "fetched"), ("paper", 2, "fetched", "converted"), ("paper", 3, "fetched", "classified"), ("paper", 4, "indexed", "indexed"), ("paper", 5, "failed_html", "converted"), ("paper", 6, "indexed", "fetched"), ("paper", 7, "extracted", "indexed")]),
    "lit_members": ("kind string, id long, collection string, is_primary boolean", [("paper", 1, "c1", True), ("paper", 1, "c2", False), ("paper", 2, "c3", True), ("repo", 10, "old", True), ("repo", 11, "keep", True), ("paper", 3, "c4", True), ("paper", 3, "c5", True)]),
    "lit_links": ("paper_id long, repo_id long", [(1, 10), (2, 12)]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = SAMPLES[name]
    return spark.createDataFrame(rows, schema)
