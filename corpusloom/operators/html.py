"""HTML to markdown with figures and references, in an Arrow UDF over the standard library's parser."""

from __future__ import annotations

import base64
import html as htmllib
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.ids import MENTION

VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
DROPPED = {"head", "script", "style", "noscript", "template"}
#: Parts of a web page that are not its text.
CHROME = {"nav", "header", "footer", "aside", "form", "button", "iframe"}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCHEMA = "struct<markdown:string,figures:array<struct<number:int,caption:string,src:string,mime:string>>,refs:array<struct<number:int,raw_text:string,cited:string>>,error:string>"
FOUND = re.compile(MENTION)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list = field(default_factory=list)

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def all(self, *tags: str):
        for k in self.kids:
            if isinstance(k, Node):
                if k.tag in tags:
                    yield k
                yield from k.all(*tags)

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else "" if k.tag in DROPPED else k.text() for k in self.kids)


class Tree(HTMLParser):
    """A lenient tree: stray ends are ignored, p and li close their like."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and any(n.tag == tag for n in self.open[-2:]):
            while self.open[-1].tag != tag:
                self.open.pop()
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def one_line(text: str) -> str:
    return " ".join(text.split())


class Converter:
    """Markdown of a tree; figures with an image are numbered in order, others are text."""

    def __init__(self, base_url: str, latex: bool):
        self.base, self.latex, self.figures = base_url, latex, []

    def kids(self, node: Node, depth: int, skip: Node | None = None) -> str:
        return "".join(re.sub(r"[ \t\r\f\v]*\n\s*", " ", k) if isinstance(k, str) else self.node(k, depth) for k in node.kids if k is not skip)

    def node(self, n: Node, depth: int) -> str:
        if n.tag in DROPPED or (not self.latex and n.tag in CHROME):
            return ""
        if n.tag == "section" and self.latex:
            return self.section(n, depth + 1)
        if n.tag in HEADS:
            if self.latex:
                return ""
            return f"\n\n{'#' * int(n.tag[1])} {one_line(n.text())}\n\n"
        if n.tag == "math":
            said = n.attrs.get("alttext") or one_line(n.text())
            return f"\n\n$${said}$$\n\n" if n.attrs.get("display") == "block" else f"${said}$"
        if n.tag == "figure":
            return self.figure(n, depth)
        if n.tag == "table":
            return f"\n\n{self.table(n)}\n\n"
        if n.tag == "pre":
            return f"\n\n```\n{n.text().strip(chr(10))}\n```\n\n"
        if n.tag == "code":
            return f"`{one_line(n.text())}`"
        if n.tag in ("ul", "ol"):
            items = [one_line(self.kids(k, depth)) for k in n.kids if isinstance(k, Node) and k.tag == "li"]
            return "\n\n" + "\n".join(f"{i}. {t}" if n.tag == "ol" else f"- {t}" for i, t in enumerate(items, 1)) + "\n\n"
        if n.tag == "p":
            return f"\n\n{self.kids(n, depth).strip()}\n\n"
        if n.tag == "br":
            return "\n"
        if n.tag in ("cite", "ref"):
            return one_line(n.text())
        if n.tag == "a" and not self.latex and (said := one_line(self.kids(n, depth))):
            href = n.attrs.get("href")
            return f"[{said}]({urljoin(self.base, href)})" if href else said
        if n.tag in ("b", "strong") and (said := one_line(self.kids(n, depth))):
            return f"**{said}**"
        if n.tag in ("div", "article", "main", "body"):
            return f"\n\n{self.kids(n, depth)}\n\n" if not self.latex else self.kids(n, depth)
        return self.kids(n, depth)

    def section(self, n: Node, depth: int) -> str:
        title = next((k for k in n.kids if isinstance(k, Node) and k.tag in HEADS), None)
        said = ""
        if title is not None:
            said = one_line("".join(k if isinstance(k, str) else "" if "ltx_tag" in k.classes else k.text() for k in title.kids))
        return (f"\n\n{'#' * min(depth, 3)} {said}\n\n" if said else "") + self.kids(n, depth, title)

    def figure(self, n: Node, depth: int) -> str:
        caption = next((one_line(k.text()) for k in n.kids if isinstance(k, Node) and k.tag == "figcaption"), "")
        if "ltx_table" in n.classes or (not any(n.all("img")) and any(n.all("table"))):
            tables = "\n\n".join(self.table(t) for t in n.all("table"))
            return f"\n\n{tables}\n\n" + (f"**{caption}**\n\n" if caption else "")
        image = next(n.all("img"), None)
        if image is None:
            return f"\n\n{one_line(n.text())}\n\n"
        src, mime = image.attrs.get("src", ""), None
        if m := re.match(r"data:([^;,]*)((?:;[^;,]*)*?)(;base64)?,", src):
            mime = m[1] or "text/plain"
            try:
                base64.b64decode(src[m.end() :], validate=True) if m[3] else None
            except ValueError:
                return f"\n\n{caption}\n\n"
        else:
            src = urljoin(self.base, src)
        number = len(self.figures) + 1
        self.figures.append({"number": number, "caption": caption, "src": src, "mime": mime})
        return f"\n\n![Figure {number}: {caption}](figure:{number})\n\n"

    def table(self, n: Node) -> str:
        rows = [[c for c in r.kids if isinstance(c, Node) and c.tag in ("td", "th")] for r in n.all("tr")]
        rows = [r for r in rows if r]
        cells = [c for r in rows for c in r]
        simple = rows and len({len(r) for r in rows}) == 1 and not any(c.attrs.get("colspan", "1") != "1" or c.attrs.get("rowspan", "1") != "1" or any(c.all("table", "img")) for c in cells)
        if not simple:
            return raw(n)
        said = [[one_line(self.kids(c, 0)).replace("|", "\\|") for c in r] for r in rows]
        lines = [f"| {' | '.join(r)} |" for r in said]
        return "\n".join([lines[0], f"|{' --- |' * len(rows[0])}", *lines[1:]])


def raw(n: Node | str) -> str:
    if isinstance(n, str):
        return htmllib.escape(n, quote=False)
    attrs = "".join(f' {k}="{htmllib.escape(v)}"' for k, v in n.attrs.items())
    return f"<{n.tag}{attrs}>" + ("" if n.tag in VOID else "".join(map(raw, n.kids)) + f"</{n.tag}>")


def cited(text: str) -> str | None:
    m = FOUND.search(text)
    return (m[1].lower() if m[1] else m[2] or m[3]) if m else None


def references(root: Node) -> list[dict]:
    items = [n for n in root.all("li", "div", "p") if "ltx_bibitem" in n.classes]
    if not items:
        for s in root.all("section", "div"):
            title = next((one_line(k.text()).lower().rstrip(":") for k in s.kids if isinstance(k, Node) and k.tag in HEADS), "")
            if re.sub(r"^[\d.]+\s*", "", title) in ("references", "bibliography"):
                items = list(s.all("p"))
                break
    out = []
    for i, n in enumerate(items, 1):
        said = one_line(n.text())
        if said:
            m = re.match(r"\[(\d+)\]\s*", said)
            out.append({"number": int(m[1]) if m else i, "raw_text": said[m.end() :] if m else said, "cited": cited(said)})
    return out


def convert(page: str | None, base_url: str = "") -> dict | None:
    """markdown, figures and refs of a page; pages of LaTeXML's kind go by their sections, others by their headings without navigation."""
    if page is None:
        return None
    tree = Tree()
    tree.feed(page)
    tree.close()
    root = tree.root
    article = next((n for n in root.all("article") if "ltx_document" in n.classes), None)
    body = article or next(root.all("article"), None) or next(root.all("main"), None) or next(root.all("body"), None) or root
    made = Converter(base_url, article is not None)
    text = made.kids(body, 0)
    text = "\n".join(line.rstrip() for line in text.split("\n"))
    return {"markdown": re.sub(r"\n{3,}", "\n\n", text).strip() + "\n", "figures": made.figures, "refs": references(body)}


def _each(rows, columns: list[str], call) -> pd.DataFrame:
    """call(*row) of each row as columns; a row that fails has nulls and what went wrong in `error`, and doesn't stop the others."""
    out = []
    for row in rows:
        try:
            out.append({"error": None, **(call(*row) or {})})
        except Exception as e:  # whatever a page makes the parser raise is that page's own
            out.append({"error": f"{type(e).__name__}: {e}"[:500]})
    return pd.DataFrame(out, columns=[*columns, "error"]).astype(object).where(lambda df: df.notna(), None)


def converted(page: Column, base_url: Column) -> Column:
    """struct<markdown, figures, refs, error> of a page."""

    @F.pandas_udf(SCHEMA)
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return _each(zip(x, y, strict=True), ["markdown", "figures", "refs"], lambda p, b: convert(p, b or ""))

    return run(page, base_url)


def page_meta(page: str | None, url: str) -> dict | None:
    """title, description, canonical of a page: meta before og before the text's first 400 characters before the title; link before og before url."""
    if page is None:
        return None
    tree = Tree()
    tree.feed(page)
    tree.close()
    meta = {(n.attrs.get("name") or n.attrs.get("property") or "").lower(): n.attrs.get("content", "") for n in tree.root.all("meta")}
    title = next((one_line(n.text()) for n in tree.root.all("title")), "") or meta.get("og:title") or next((one_line(n.text()) for n in tree.root.all("h1")), "")
    body = next(tree.root.all("body"), tree.root)
    link = next((n.attrs.get("href") for n in tree.root.all("link") if n.attrs.get("rel") == "canonical"), None)
    return {"title": title or None, "description": meta.get("description") or meta.get("og:description") or one_line(body.text())[:400] or title or None, "canonical": urljoin(url, link or meta.get("og:url") or url)}


def metadata(page: Column, url: Column) -> Column:
    """struct<title, description, canonical, error> of a page."""

    @F.pandas_udf("struct<title:string,description:string,canonical:string,error:string>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return _each(zip(x, y, strict=True), ["title", "description", "canonical"], lambda p, u: page_meta(p, u or ""))

    return run(page, url)
