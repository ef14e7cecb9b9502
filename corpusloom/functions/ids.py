"""Identifiers and slugs as column expressions: preprints, anthology papers, repositories, figures, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip_accents

#: Words a slug leaves out, hosts of repositories and their short names.
STOP_WORDS = ("a", "the", "on", "of", "for", "and", "in", "to", "with", "is", "are", "be")
HOSTS = {"github.com": "gh", "gitlab.com": "gl", "bitbucket.org": "bb"}
#: Signs that end a sentence rather than a URL; the two formats of preprint ids.
TRAILING = ".,);:!?]}>"
MODERN, LEGACY = r"\d{4}\.\d{4,5}", r"[a-z\-]+/\d{7}"
MENTION = rf"(?i)arxiv\s*:\s*(?:({LEGACY})|({MODERN}))|(?:https?://)?(?:www\.)?arxiv\.org/abs/({MODERN})"


def _or_null(x: Column) -> Column:
    return F.when(x != "", x)


def preprint_id(raw: Column) -> Column:
    """The id of an abs or pdf URL or of a bare id, its version kept; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^https?://arxiv\.org/(?:abs|pdf)/", ""), r"\.pdf$", "")
    return F.when(bare.rlike(rf"^(?:{MODERN}|{LEGACY})(?:v\d+)?$"), bare)


def mentioned_id(text: Column) -> Column:
    """The first preprint id a text mentions, without its version; old ids in lower case; null if there is none."""
    old, new, url = (F.regexp_extract(text, MENTION, i) for i in (1, 2, 3))
    return F.coalesce(_or_null(F.lower(old)), _or_null(new), _or_null(url))


def anthology_id(raw: Column) -> Column:
    """The id of an anthology URL (page, .pdf, .xml or .bib) or of a bare id; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^(?:https?://)?(?:www\.)?aclanthology\.org/", ""), "/+$", "")
    bare = F.regexp_replace(bare, r"\.(?:pdf|xml|bib)$", "")
    return F.when(bare.rlike(r"^(?:\d{4}\.[a-z][a-z0-9]*(?:-[a-z0-9]+)*\.\d+|[A-Z]\d{2}-\d{4})$"), bare)


def repo_url(raw: Column) -> Column:
    """https://host/owner/name of a repository's root; null where the host is another or the path isn't two deep."""
    clean = F.rtrim(F.trim(raw), F.lit(TRAILING))
    parts = F.filter(F.split(F.split_part(F.split_part(clean, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "/"), lambda x: x != "")
    scheme, host, owner, name = (F.get(parts, i) for i in range(4))
    host = F.lower(host)
    host = F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(host)
    name = F.when(name.endswith(".git"), F.left(name, F.length(name) - 4)).otherwise(name)
    root = F.lower(scheme).isin("http:", "https:") & clean.contains("://") & host.isin(*HOSTS) & (F.size(parts) == 4) & (name != "")
    return F.when(root, F.concat(F.lit("https://"), host, F.lit("/"), owner, F.lit("/"), name))


def repo_slug(url: Column) -> Column:
    """gh-owner-name of a repository URL as repo_url() gives it."""
    host, owner, name = (F.element_at(F.split(url, "/"), i) for i in (3, 4, 5))
    short = F.lit(None).cast("string")
    for h, s in HOSTS.items():
        short = F.when(host == h, F.lit(s)).otherwise(short)
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", short, _or_null(plain(owner)), _or_null(plain(name)))


def _unversioned(x: Column) -> Column:
    """A path segment without a version, v and a number, at its end."""
    return F.regexp_replace(x, r"v\d+$", "")


def _id_segments(parts: Column, at: Column) -> Column:
    """How many of the path segments from place `at` (from 0) are a preprint id, its version aside: one, two for an old id, 0 if they are none."""
    first, both = _unversioned(F.get(parts, at)), F.concat_ws("/", F.get(parts, at), _unversioned(F.get(parts, at + 1)))
    return F.when(first.rlike(f"^{MODERN}$"), 1).when(both.rlike(f"^{LEGACY}$"), 2).otherwise(0)


def figure_url(url: Column) -> Column:
    """A figure's URL with an id that stands twice in its path, the second time with or without a version, folded into one."""
    parts = F.split(url, "/")
    at = F.array_position(parts, "html").cast("int")
    n = _id_segments(parts, at)
    once, again = (F.slice(parts, lo, F.greatest(n, F.lit(1))) for lo in (at + 1, at + 1 + n))
    same = (F.concat_ws("/", once) == _unversioned(F.concat_ws("/", again))) & (F.size(parts) > at + 2 * n)
    rest = F.slice(parts, at + 1 + n, F.size(parts))
    return F.when((at > 0) & (n > 0) & same, F.concat_ws("/", F.slice(parts, 1, at), rest)).otherwise(url)


def figure_mirror(url: Column) -> Column:
    """Where the mirror has a figure, by the id without its version; null for URLs of other sites."""
    parts = F.split(url, "/")
    n = _id_segments(parts, F.lit(4))
    own = F.concat_ws("/", F.slice(parts, 1, 4)) == "https://arxiv.org/html"
    paper, rest = _unversioned(F.concat_ws("/", F.slice(parts, 5, F.greatest(n, F.lit(1))))), F.concat_ws("/", F.slice(parts, n + 5, F.greatest(F.size(parts), F.lit(1))))
    return F.when(own & (n > 0) & (rest != ""), F.concat(F.lit("https://ar5iv.labs.arxiv.org/html/"), paper, F.lit("/assets/"), rest))


def _title_words(title: Column) -> Column:
    folded = F.lower(strip_accents(title))
    own = F.filter(F.split(F.regexp_replace(folded, r"[^a-z0-9\s]+", " "), r"\s+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_join(F.slice(own, 1, 3), "_")


def paper_slug(title: Column, date: Column, other: Column) -> Column:
    """What stands before a colon, squeezed, else the first three words that count; `other` where nothing is left; then the year."""
    before = F.regexp_replace(F.lower(strip_accents(F.substring_index(title, ":", 1))), "[^a-z0-9]+", "")
    base = F.when(F.instr(title, ":") > 0, before).otherwise(_title_words(title))
    return F.concat_ws("_", F.coalesce(_or_null(base), other), F.substring(date, 1, 4))


def plain_id(raw: Column) -> Column:
    """An id without version and signs, as slugs use it to tell equal ones apart."""
    return F.regexp_replace(F.lower(F.regexp_replace(raw, r"v\d+$", "")), "[^a-z0-9]+", "")


def chapter_slug(book: Column, number: Column, title: Column) -> Column:
    words = F.coalesce(_or_null(_title_words(title)), F.concat(F.lit("ch"), number.cast("string")))
    return F.when(number.between(1, 99), F.concat(book, F.lit("__ch"), F.lpad(number.cast("string"), 2, "0"), F.lit("_"), words))


def in_slot(slug: Column, book: Column, number: Column) -> Column:
    """Whether a slug is a chapter in that slot of the book, whatever its title; `_` and `%` in the book's slug stand for themselves."""
    return F.startswith(slug, F.concat(book, F.lit("__ch"), F.lpad(number.cast("string"), 2, "0"), F.lit("_")))


def pdf_date(raw: Column) -> Column:
    """YYYY-MM-DD of a PDF date D:YYYYMMDD...; null for others."""
    return _or_null(F.regexp_replace(F.regexp_extract(raw, r"^D:(\d{8})", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))


def local_id(content: Column, chapter: Column) -> Column:
    """pdf:<12 hex digits>[:chNN] of a local file's bytes."""
    base = F.concat(F.lit("pdf:"), F.substring(F.sha2(content, 256), 1, 12))
    return F.when(chapter.isNull(), base).otherwise(F.concat(base, F.lit(":ch"), F.lpad(chapter.cast("string"), 2, "0")))
