"""Books and chapters: HTML text, EPUB archives."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom import constants as K



class _Page(HTMLParser):
    """Collects the title, the first heading and the body text of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.heading, self.body = None, None, []
        self._in_title = self._in_head = False
        self._heading_tag = None

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self._in_head = True
        elif tag == "body":
            self._in_head = False
        elif tag == "title" and self.title is None:
            self._in_title, self.title = True, ""
        elif tag in ("h1", "h2", "h3") and self.heading is None:
            self._heading_tag, self.heading = tag, ""

    def handle_endtag(self, tag):
        if tag == "head":
            self._in_head = False
        elif tag == "title":
            self._in_title = False
        elif tag == self._heading_tag:
            self._heading_tag = None

    def handle_data(self, data):
        if self._in_title:
            self.title += data
            return
        if self._heading_tag:
            self.heading += data
        if not self._in_head:
            self.body.append(data)


def own_title(html: str) -> str:
    """The text of `<title>`, empty without one."""
    p = _Page()
    p.feed(html)
    p.close()
    return (p.title or "").strip()


def page_text(html: str, name: str) -> tuple[str, str]:
    """(title, text): `<title>`, else the first heading, else the file name."""
    p = _Page()
    p.feed(html)
    p.close()
    title = (p.title or "").strip() or (p.heading or "").strip() or re.sub(r"\.x?html?$", "", name, flags=re.I)
    return title, "".join(p.body).strip()


def chapter_text(pages: DataFrame, name: str = "url", html: str = "html") -> DataFrame:
    """(…, title, text, empty): title and trimmed text of HTML pages, other columns kept."""
    keep = [f for f in pages.schema.fields if f.name not in (html,)]
    names = [f.name for f in keep]

    def job(batches):
        for pdf in batches:
            out = pdf[names].copy()
            parsed = [page_text(h or "", n or "") for h, n in zip(pdf[html], pdf[name])]
            out["title"] = [t for t, _ in parsed]
            out["text"] = [b for _, b in parsed]
            out["empty"] = [not b for _, b in parsed]
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return pages.mapInPandas(job, f"{fields}, title string, text string, empty boolean")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def epub_chapters(data: bytes):
    """Yield (ord, part, title, text, spine, files) of an archive: chapters in reading
    order; when under half of the reading order gave text and there are other files,
    pages not used yet follow. A chapter without text is yielded with an empty text."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    names = [n for n in archive.namelist() if not n.endswith("/")]
    folded = {n.lower(): n for n in names}

    def read(path):
        real = path if path in names else folded.get(path.lower())
        return archive.read(real).decode("utf-8", "replace") if real else None

    try:
        container = read("META-INF/container.xml")
        root = next(e for e in ElementTree.fromstring(container).iter() if _local(e.tag) == "rootfile").get("full-path")
        package = ElementTree.fromstring(read(root))
    except (TypeError, StopIteration, ElementTree.ParseError):
        return
    items = {e.get("id"): (e.get("href") or "", (e.get("media-type") or "").lower()) for e in package.iter() if _local(e.tag) == "item"}
    spine = [e.get("idref") for e in package.iter() if _local(e.tag) == "itemref" and e.get("idref")]
    base, used, good, order = posixpath.dirname(root), set(), 0, 0
    for ref in spine:
        href, mime = items.get(ref, ("", ""))
        if "html" not in mime:
            continue
        part = href[1:] if href.startswith("/") else posixpath.join(base, href)
        html = read(part.replace("\\", "/"))
        if html is None:
            continue
        used.add(part.lower())
        title, text = page_text(html, href)
        good += bool(text)
        yield order, part, title, text, len(spine), len(names)
        order += 1
    if good < len(spine) * K.SPINE_SHARE and len(names) > len(spine):
        for part in names:
            low = part.lower()
            if not re.search(r"\.x?html?$", low) or "nav" in low or "toc" in low or low in used:
                continue
            html = read(part)
            text = page_text(html, part)[1]
            title = own_title(html) or part
            if len(text) >= K.FALLBACK_MIN_CHARS:
                yield order, part, f"{title} (fallback)", text, len(spine), len(names)
                order += 1


EPUB_SCHEMA = "book string, ord int, part string, title string, text string, spine int, files int"


def parse_epub(archives: DataFrame, book: str = "path", content: str = "content") -> DataFrame:
    """Chapters of many archives held as bytes, one row per chapter."""

    def job(batches):
        for pdf in batches:
            rows = [(b, *chapter) for b, data in zip(pdf[book], pdf[content]) for chapter in epub_chapters(bytes(data))]
            yield pd.DataFrame(rows, columns=["book", "ord", "part", "title", "text", "spine", "files"])

    return archives.select(book, content).mapInPandas(job, EPUB_SCHEMA)


def read_epub(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(root)
    named = files.select(F.url_decode(F.substring_index("path", "/", -1)).alias("path"), "content")
    return parse_epub(named)
