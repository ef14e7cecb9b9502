"""LaTeX sources to markdown: assembly of a source tree, a small reader, figures and references, in an Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 32
HEADS = {"section": 1, "subsection": 2, "subsubsection": 3, "chapter": 1}
MARKS = {"textbf": "**", "textit": "*", "emph": "*", "texttt": "`"}
RASTER = ("png", "jpg", "jpeg", "gif")
#: Commands whose argument is not text.
SILENT = {"label", "vspace", "hspace", "bibliographystyle", "bibliography", "usepackage", "documentclass", "maketitle", "input", "include", "centering", "newcommand", "renewcommand", "setlength", "thanks", "footnotetext", "graphicspath"}
SCHEMA = "struct<markdown:string,figures:array<struct<number:int,path:string,caption:string,label:string>>,refs:array<struct<key:string,raw_text:string>>>"


def bare(text: str) -> str:
    """Without comments; a line that was only a comment goes."""
    return re.sub(r"(?m)(?<!\\)%.*$", "", re.sub(r"(?m)^[ \t]*%.*\n", "", text))


def main_file(files: dict[str, str]) -> str | None:
    """The file with a document class: main, paper or ms first, then by name."""
    found = [p for p, t in files.items() if p.endswith(".tex") and r"\documentclass" in bare(t)]
    order = {"main.tex": 0, "paper.tex": 1, "ms.tex": 2}
    return min(found, key=lambda p: (order.get(p.rpartition("/")[2].lower(), 3), p), default=None)


def assemble(files: dict[str, str]) -> str | None:
    """The main file with its inputs in place, missing and circular ones as a comment, and all .bbl files behind it."""
    top = main_file(files)
    if top is None:
        return None

    def inline(path: str, above: tuple[str, ...]) -> str:
        def put(m: re.Match) -> str:
            name = m[1].strip()
            at = next((p for p in (name, f"{name}.tex", *(f"{path.rpartition('/')[0]}/{n}" for n in (name, f"{name}.tex"))) if p in files), None)
            if at is None or at in above or len(above) >= DEPTH:
                return f"% not included: {name}\n"
            return inline(at, (*above, at))

        return re.sub(r"\\(?:input|include)\s*\{([^}]*)\}", put, bare(files[path]))

    return "\n".join([inline(top, (top,)), *(bare(t) for p, t in sorted(files.items()) if p.endswith(".bbl"))])


def group(text: str, at: int) -> tuple[str, int]:
    """The braced group that begins at `at` (or what lies there without braces: one sign) and where it ends."""
    while at < len(text) and text[at] in " \t\n":
        at += 1
    if at >= len(text) or text[at] != "{":
        return text[at : at + 1], at + 1
    depth = 0
    for i in range(at, len(text)):
        if text[i] in "{}" and (i == 0 or text[i - 1] != "\\"):
            depth += 1 if text[i] == "{" else -1
            if not depth:
                return text[at + 1 : i], i + 1
    return text[at + 1 :], len(text)


def option(text: str, at: int) -> int:
    m = re.compile(r"\s*\[[^\]]*\]").match(text, at)
    return m.end() if m else at


class Reader:
    def __init__(self) -> None:
        self.figures: list[dict] = []
        self.refs: list[dict] = []

    def read(self, text: str) -> str:
        out, at = [], 0
        for m in re.compile(r"\\begin\{([a-zA-Z]+)(\*?)\}|\\([a-zA-Z]+)\*?|\\(.)|\$\$(.+?)\$\$|\$([^$]+)\$|[{}~]", re.DOTALL).finditer(text):
            if m.start() < at:
                continue
            out.append(text[at : m.start()])
            at = m.end()
            if m[1]:
                stop = self.end(text, m[1] + m[2], at)
                out.append(self.environment(m[1], text[at : stop[0]]))
                at = stop[1]
            elif m[3]:
                said, at = self.command(m[3], text, at)
                out.append(said)
            elif m[4]:
                if m[4] in "([":
                    close = {"(": r"\)", "[": r"\]"}[m[4]]
                    stop = text.find(close, at)
                    stop = len(text) if stop < 0 else stop
                    out.append(f"${text[at:stop].strip()}$" if m[4] == "(" else f"\n\n$${text[at:stop].strip()}$$\n\n")
                    at = stop + 2
                else:
                    out.append("\n" if m[4] == "\\" else m[4] if m[4] in "%&_#$ {}" else "")
            elif m[5]:
                out.append(f"\n\n$${m[5].strip()}$$\n\n")
            elif m[6]:
                out.append(f"${m[6].strip()}$")
            else:
                out.append(" " if m[0] == "~" else "")
        return "".join([*out, text[at:]])

    @staticmethod
    def end(text: str, name: str, at: int) -> tuple[int, int]:
        depth = 1
        for m in re.compile(rf"\\(begin|end)\{{{re.escape(name)}\}}").finditer(text, at):
            depth += 1 if m[1] == "begin" else -1
            if not depth:
                return m.start(), m.end()
        return len(text), len(text)

    def command(self, name: str, text: str, at: int) -> tuple[str, int]:
        if name in ("item", "LaTeX", "TeX", "ldots", "dots", "quad", "par", "noindent"):
            return {"LaTeX": "LaTeX", "TeX": "TeX", "ldots": "...", "dots": "...", "par": "\n\n"}.get(name, " "), at
        had = option(text, at)
        if had >= len(text) or text[had : had + 1] != "{":
            return "", at
        inner, end = group(text, had)
        if name in HEADS:
            return f"\n\n{'#' * HEADS[name]} {' '.join(self.read(inner).split())}\n\n", end
        if name in MARKS:
            return f"{MARKS[name]}{self.read(inner)}{MARKS[name]}", end
        if name.startswith("cite"):
            return f"[{inner}]", end
        if name in ("ref", "eqref", "autoref", "cref"):
            return inner, end
        if name == "href":
            said, end = group(text, end)
            return f"[{self.read(said)}]({inner})", end
        if name == "url":
            return f"<{inner}>", end
        if name in SILENT:
            return "", end
        return self.read(inner), end

    def environment(self, name: str, body: str) -> str:
        if name in ("equation", "align", "gather", "multline", "eqnarray", "displaymath"):
            return f"\n\n$${body.strip()}$$\n\n"
        if name in ("itemize", "enumerate", "description"):
            parts = [p for p in re.split(r"\\item\b", body)[1:]]
            return "\n\n" + "\n".join(f"{f'{i}.' if name == 'enumerate' else '-'} {' '.join(self.read(p).split())}" for i, p in enumerate(parts, 1)) + "\n\n"
        if name in ("verbatim", "lstlisting", "minted"):
            return f"\n\n```\n{body.strip(chr(10))}\n```\n\n"
        if name == "abstract":
            return f"\n\n# Abstract\n\n{self.read(body)}\n\n"
        if name == "figure":
            return self.figure(body)
        if name in ("tabular", "tabularx", "array"):
            return self.table(body)
        if name == "thebibliography":
            for part in re.split(r"\\bibitem", body)[1:]:
                key, end = group(part, option(part, 0))
                self.refs.append({"key": key, "raw_text": " ".join(self.read(part[end:]).split())})
            return ""
        return self.read(re.sub(r"^\s*\[[^\]]*\]", "", body))

    def figure(self, body: str) -> str:
        number = len(self.figures) + 1
        path = re.search(r"\\includegraphics\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}", body)
        captions = [" ".join(self.read(group(body, option(body, m.end()))[0]).split()) for m in re.finditer(r"\\caption(?=[\[{])", body)]
        label = re.search(r"\\label\{([^}]*)\}", body)
        self.figures.append({"number": number, "path": path[1].strip() if path else None, "caption": " ".join(captions), "label": label[1] if label else None})
        return f"\n\n![Figure {number}: {' '.join(captions)}](figure:{number})\n\n"

    def table(self, body: str) -> str:
        _, at = group(body, option(body, 0))
        rows = [[" ".join(self.read(c).split()).replace("|", "\\|") for c in re.split(r"(?<!\\)&", r)] for r in re.split(r"\\\\", re.sub(r"\\(?:hline|toprule|midrule|bottomrule)\b|\\cline\{[^}]*\}", "", body[at:])) if r.strip()]
        if not rows or len({len(r) for r in rows}) > 1:
            return "\n\n<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>\n\n"
        lines = [f"| {' | '.join(r)} |" for r in rows]
        return "\n\n" + "\n".join([lines[0], f"|{' --- |' * len(rows[0])}", *lines[1:]]) + "\n\n"


def convert(files: dict[str, str] | None) -> dict | None:
    """markdown, figures and refs of a source tree (path to text); null without a main file."""
    text = assemble(files) if files else None
    if text is None:
        return None
    body = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)(.*)", text, re.DOTALL)
    reader = Reader()
    said = reader.read(body[1] + body[2] if body else text)
    said = "\n".join(line.strip(" \t") for line in re.sub(r"(?<!\n)\n(?!\n)", "\n", said).split("\n"))
    return {"markdown": re.sub(r"\n{3,}", "\n\n", said).strip() + "\n", "figures": reader.figures, "refs": reader.refs}


def resolve_figure(path: str, files: list[str]) -> str | None:
    """The file a figure's path names, as it stands or with a raster ending; null for other formats, which get a placeholder."""
    found = next((p for p in (path, *(f"{path}.{e}" for e in RASTER)) if p in files), None)
    return found if found and found.rpartition(".")[2].lower() in RASTER else None


def converted(files: Column) -> Column:
    """struct<markdown, figures, refs> of a map of paths to texts."""

    @F.pandas_udf(SCHEMA)
    def run(x: pd.Series) -> pd.DataFrame:
        rows = [convert(dict(f) if f is not None else None) or {"markdown": None, "figures": None, "refs": None} for f in x]
        return pd.DataFrame(rows, columns=["markdown", "figures", "refs"])

    return run(files)
