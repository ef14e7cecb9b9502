from pyspark.sql import functions as F

from corpusloom.operators import latex

FILES = {
    "main.tex": "\\documentclass{article}\n% comment\n\\begin{document}\n\\begin{abstract}Short \\emph{text}.\\end{abstract}\n\\input{sec/one}\\input{none}\n\\begin{figure}\\includegraphics[width=1cm]{img/a}\\caption{A \\textbf{cap}}\\label{f:a}\\end{figure}\n\\end{document}",
    "sec/one.tex": "\\section{One \\& two}\nHello~$x^2$ \\cite{lee} 50\\% done.\n\\begin{itemize}\\item a \\item b\\end{itemize}\n\\begin{tabular}{ll}\\hline p & q \\\\ 1 & 2 \\\\\\end{tabular}\n\\[ y = 1 \\]\n\\input{main}",
    "main.bbl": "\\begin{thebibliography}{1}\\bibitem[x]{lee} Lee. \\emph{Title}. arXiv:2310.08560\\end{thebibliography}",
    "other.tex": "no class",
}


def test_convert():
    own = latex.convert(FILES)
    for part in ["# Abstract\n\nShort *text*.", "# One & two\n", "Hello $x^2$ [lee] 50% done.", "- a\n- b", "| p | q |\n| --- | --- |\n| 1 | 2 |", "$$y = 1$$", "![Figure 1: A **cap**](figure:1)"]:
        assert part in own["markdown"], (part, own["markdown"])
    assert own["figures"] == [{"number": 1, "path": "img/a", "caption": "A **cap**", "label": "f:a"}]
    assert own["refs"] == [{"key": "lee", "raw_text": "Lee. *Title*. arXiv:2310.08560"}]
    assert "comment" not in own["markdown"] and latex.convert({"a.tex": "x"}) is None and latex.convert(None) is None
    assert latex.main_file({"z.tex": "\\documentclass{a}", "x/paper.tex": "\\documentclass{a}"}) == "x/paper.tex"


def test_figures():
    assert latex.resolve_figure("img/a", ["img/a.png"]) == "img/a.png"
    assert latex.resolve_figure("img/a.pdf", ["img/a.pdf"]) is None


def test_column(spark):
    df = spark.createDataFrame([(FILES,), (None,), ({},)], "files map<string,string>")
    got = [r["c"]["markdown"] for r in df.select(latex.converted(F.col("files")).alias("c")).collect()]
    assert got[0] and got[1:] == [None, None]
