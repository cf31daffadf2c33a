"""Packaged books (EPUB): entries read safely, chapters and blocks as tables, and packages written.

Archives come from Spark's binaryFile source, so any store that Spark reads will do; each is opened in the
task that holds it."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as XML

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.markup import TEXT_TAGS, blocks_of, prose, tag
from quire.functions.text import section_kind
from quire.session import BATCH_ROWS, bounded, written

#: Books that are made anew at a time.
BOOKS = 20
#: Media types of chapters.
CHAPTERS = ("application/xhtml+xml", "text/html")


def unsafe(name: str, mode: int = 0) -> str | None:
    """Why an archive's entry is refused."""
    path = name.replace("\\", "/")
    kind = mode >> 12 & 0xF
    if not path or "\0" in path:
        return "no name"
    if path.startswith("/") or re.match(r"[A-Za-z]:", path):
        return "absolute"
    if ".." in path.split("/"):
        return "outside"
    if kind not in (0, 4, 8):
        return "no regular file"
    return None


def entries(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for i in z.infolist():
            if why := unsafe(i.filename, i.external_attr >> 16):
                raise ValueError(f"entry refused ({why}): {i.filename}")
        return {i.filename.replace("\\", "/"): z.read(i) for i in z.infolist() if not i.is_dir()}


def _root(files: dict[str, bytes]) -> str:
    if "META-INF/container.xml" not in files:
        raise ValueError("no container.xml")
    for e in XML.fromstring(files["META-INF/container.xml"]).iter():
        if tag(e) == "rootfile" and e.attrib.get("full-path"):
            return e.attrib["full-path"]
    raise ValueError("no rootfile")


def _labels(files: dict[str, bytes], opf: str, manifest: dict[str, dict]) -> dict[str, str]:
    """Labels by file; the NCX table comes before the navigation document, the first label stays."""
    out: dict[str, str] = {}
    resolve = lambda base, href: posixpath.normpath(posixpath.join(posixpath.dirname(base), href.partition("#")[0]))
    here = lambda m: resolve(opf, m["href"])
    for m in manifest.values():
        if m["media_type"] == "application/x-dtbncx+xml" and here(m) in files:
            for p in (e for e in XML.fromstring(files[here(m)]).iter() if tag(e) == "navPoint"):
                text = next((" ".join("".join(e.itertext()).split()) for e in p if tag(e) == "navLabel"), "")
                src = next((e.attrib.get("src", "") for e in p if tag(e) == "content"), "")
                if text and src:
                    out.setdefault(resolve(here(m), src), text)
    for m in manifest.values():
        if "nav" in m["properties"].split() and here(m) in files:
            try:
                root = XML.fromstring(files[here(m)])
            except XML.ParseError:
                continue
            for nav in (e for e in root.iter() if tag(e) == "nav"):
                kind = next((v for k, v in nav.attrib.items() if k.rpartition("}")[2] == "type"), "toc")
                for a in nav.iter() if "toc" in kind.split() else ():
                    if tag(a) == "a" and a.attrib.get("href"):
                        out.setdefault(resolve(here(m), a.attrib["href"]), " ".join("".join(a.itertext()).split()))
    return out


def _package(files: dict[str, bytes]) -> tuple[str, dict[str, dict], list[str]]:
    """The package document's path, its manifest (the later of a repeated id), and the spine."""
    opf = _root(files)
    root = XML.fromstring(files[opf])
    manifest = {
        e.attrib["id"]: {"href": e.attrib["href"], "media_type": e.attrib.get("media-type", ""), "properties": e.attrib.get("properties", "")}
        for e in root.iter() if tag(e) == "item" and e.attrib.get("id") and e.attrib.get("href")
    }
    return opf, manifest, [e.attrib.get("idref", "") for e in root.iter() if tag(e) == "itemref"]


def _path(base: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), href))


def read_chapters(content: bytes) -> tuple[dict[str, bytes], list[tuple[int, str, str, list[tuple], str | None]]]:
    """A book's files, and its chapters in reading order: (order, file, label, blocks, error). A chapter that
    cannot be read has an error and no blocks; the others are not touched by it."""
    files = entries(content)
    opf, manifest, spine = _package(files)
    labels, out = _labels(files, opf, manifest), []
    for ref in spine:
        m = manifest.get(ref)
        if not m or m["media_type"] not in CHAPTERS:
            continue
        file = _path(opf, m["href"])
        try:
            found, error = blocks_of(files[file].decode("utf-8", "replace")), None
        except KeyError:
            found, error = [], f"no such file: {file}"
        except XML.ParseError as e:
            found, error = [], f"{file}: {e}"
        out.append((len(out) + 1, file, labels.get(file, ""), found, error))
    return files, out


def read_blocks(content: bytes) -> list[tuple]:
    """(order, file, label, seq, tag, text, html) of a book, in reading order."""
    return [(order, file, label, *b) for order, file, label, found, _ in read_chapters(content)[1] for b in found]


SCHEMA = "book string, order int, file string, label string, seq int, tag string, text string, html string, error string"


def _books(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all books under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")


def _read(books: DataFrame, read, schema: str) -> DataFrame:
    """read(book, content) over books (path, content); what it cannot open is a row with nothing but an error."""
    bounded(books.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]
    whole = {x.split()[0]: "Int32" for x in schema.split(", ") if x.split()[1] == "int"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for book, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows = read(book, bytes(content))
                except (ValueError, KeyError, zipfile.BadZipFile, XML.ParseError) as e:
                    rows = [(book, *[None] * (len(names) - 2), str(e))]
                # A book at a time: of all books of a frame, rows would be many times what came.
                for i in range(0, len(rows), BATCH_ROWS):
                    yield pd.DataFrame(rows[i : i + BATCH_ROWS], columns=names).astype(whole)

    return books.select("path", "content").mapInPandas(run, schema)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all books under a path; a chapter or a book that cannot be read is one row with its error."""
    return blocks_in(_books(spark, path))


def blocks_in(books: DataFrame) -> DataFrame:
    """The same of books in a table (path, content)."""

    def read(book: str, content: bytes) -> list[tuple]:
        out: list[tuple] = []
        for order, file, label, found, error in read_chapters(content)[1]:
            out += [(book, order, file, label, *b, None) for b in found] if not error else [(book, order, file, label, None, None, None, None, error)]
        return out

    return _read(books, read, SCHEMA).withColumn("kind", section_kind(F.col("label")))


CHAPTER = "book string, order int, file string, label string, block_count int, error string"


def chapters(spark: SparkSession, path: str) -> DataFrame:
    """The chapters of all books under a path, with how many blocks each has."""
    read = lambda book, content: [(book, order, file, label, len(found), error) for order, file, label, found, error in read_chapters(content)[1]]
    return _read(_books(spark, path), read, CHAPTER).withColumn("kind", section_kind(F.col("label")))


#: Attributes that name resources, by element.
RESOURCES = {
    "audio": ("src",), "embed": ("src",), "img": ("src",), "image": ("href", "src"), "link": ("href",), "object": ("data",), "script": ("src",), "source": ("src", "srcset"), "track": ("src",),
    "video": ("src", "poster"),
}
PART = "book string, part string, pos int, file string, id string, kind string, value string, error string"


def parts_of(book: str, content: bytes) -> list[tuple]:
    """What an audit needs of a book, as rows of PART: manifest, spine, file, id, reference, target and point."""
    files = entries(content)
    opf, manifest, spine = _package(files)
    out = [(book, "manifest", i, _path(opf, m["href"]), k, m["media_type"], None, None) for i, (k, m) in enumerate(manifest.items())]
    out += [(book, "spine", i, None, ref, None, None, None) for i, ref in enumerate(spine)]
    out += [(book, "file", i, f, None, None, None, None) for i, f in enumerate(files)]
    ncx = next((_path(opf, m["href"]) for m in manifest.values() if m["media_type"] == "application/x-dtbncx+xml"), None)
    for e in XML.fromstring(files[ncx]).iter() if ncx in files else ():
        if tag(e) == "navPoint":
            out.append((book, "point", None, None, None, None, None, None))
        if tag(e) == "pageTarget":
            src = next((c.attrib.get("src") for c in e if tag(c) == "content"), None)
            file, _, anchor = (src or "").partition("#")
            out.append((book, "target", None, _path(opf, file) if "#" in (src or "") else None, anchor or None, None, src, None))
    for file, data in files.items():
        if posixpath.splitext(file)[1].lower() not in (".xhtml", ".html", ".htm"):
            continue
        try:
            root = XML.fromstring(data)
        except XML.ParseError as e:
            out.append((book, "reference", None, file, None, "parse error", None, str(e)))
            continue
        for e in root.iter():
            if e.attrib.get("id"):
                out.append((book, "id", None, file, e.attrib["id"], None, None, None))
            if e.attrib.get("href"):
                out.append((book, "reference", None, file, None, "href", e.attrib["href"], None))
            for a in RESOURCES.get(tag(e), ()):
                values = [x.strip().split(" ", 1)[0] for x in e.attrib.get(a, "").split(",")] if a == "srcset" else [e.attrib.get(a, "")]
                out += [(book, "reference", None, file, None, "resource", v, None) for v in values if v]
    return out


def audited(spark: SparkSession, path: str) -> DataFrame:
    """The audit report of all books under a path: a row each."""
    return audited_in(_books(spark, path))


def parts_in(books: DataFrame) -> DataFrame:
    """What an audit needs of books in a table (path, content), as rows of PART."""
    return _read(books, parts_of, PART).where(F.col("part").isNotNull())


def audited_in(books: DataFrame) -> DataFrame:
    """The audit report of books in a table (path, content)."""
    from quire.operators import audit

    x = written(parts_in(books), "parts")
    part = lambda name: x.where(F.col("part") == name)
    manifest = part("manifest").select("book", "id", "file", F.col("kind").alias("media_type"))
    files, ids = part("file").select("book", "file"), part("id").select("book", "file", "id")
    references = part("reference").where("kind <> 'parse error'").select("book", "file", "kind", "value")
    targets = part("target").select("book", F.col("value").alias("src"), "file", F.col("id").alias("anchor"))
    unread = part("reference").where("kind = 'parse error'").select("book", F.lit("broken_internal_link").alias("finding"), F.concat("file", F.lit(": XML parse error: "), "error").alias("value"), F.lit(1).cast("long").alias("n"))
    found = audit.findings(manifest, files, ids, references, targets).unionByName(unread)
    counts = audit.counters(manifest, part("spine").select("book", "pos", F.col("id").alias("idref")), files, references, targets, part("point").select("book"))
    return audit.report(counts, found)


def intact(content: bytes) -> dict[str, bool]:
    """Whether an archive is whole, begins with its media type, and stores that uncompressed."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        kind = next((i for i in infos if i.filename == "mimetype"), None)
        return {
            "zip_intact": z.testzip() is None, "mimetype_first": bool(infos) and infos[0].filename == "mimetype", "mimetype_stored": bool(kind and kind.compress_type == zipfile.ZIP_STORED),
            "mimetype_ok": bool(kind) and z.read(kind) == b"application/epub+zip",
        }


def bound(chapters: DataFrame) -> DataFrame:
    """(path, content): a package for each book of chapters (book, pos, file, title, paragraphs, links, targets: anchors that
    the page list names). A heading has the id h0, paragraphs p1, p2 and so on; links stand beside them. What makes an
    archive meets in one task, as it does in the archive."""
    from html import escape

    def bind(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        files: dict[str, bytes] = {"META-INF/container.xml": b'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'}
        items, spine, points, targets = ['<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'], [], [], []
        for i, (file, title, paragraphs, links, marks) in enumerate(zip(*(group[c] for c in ("file", "title", "paragraphs", "links", "targets")), strict=True)):
            body = [f'<h1 id="h0" class="title">{escape(title)}</h1>', *[f'<p id="p{k}" class="text">{escape(x)}</p>' for k, x in enumerate(paragraphs, 1)], *[f'<div><a href="{escape(x)}">+</a></div>' for x in links]]
            files[file] = f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(title)}</title></head><body>{"".join(body)}</body></html>'.encode("utf-8", "replace")
            items.append(f'<item id="c{i}" href="{escape(file)}" media-type="application/xhtml+xml"/>')
            spine.append(f'<itemref idref="c{i}"/>')
            points.append(f'<navPoint id="n{i}"><navLabel><text>{escape(title)}</text></navLabel><content src="{escape(file)}"/></navPoint>')
            targets += [f'<pageTarget id="t{i}-{k}"><content src="{escape(file)}#{escape(x)}"/></pageTarget>' for k, x in enumerate(marks)]
        files["content.opf"] = f'<package xmlns="http://www.idpf.org/2007/opf" version="2.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(str(group["book"].iloc[0]))}</dc:title></metadata><manifest>{"".join(items)}</manifest><spine toc="ncx">{"".join(spine)}</spine></package>'.encode()
        files["toc.ncx"] = f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{"".join(points)}</navMap><pageList>{"".join(targets)}</pageList></ncx>'.encode("utf-8", "replace")
        return pd.DataFrame({"path": [group["book"].iloc[0]], "content": [package(files)]})

    return chapters.groupBy("book").applyInPandas(bind, "path string, content binary")


def applied_in(books: DataFrame, new: DataFrame) -> DataFrame:
    """Books (path, content) with their blocks replaced by new markup (book, id: file::seq, html), as `applied` does; a book of
    which a block is missing fails."""
    bounded(books.sparkSession)
    per = new.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("id", "html"))).alias("new"))  # one book's blocks

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), BOOKS):
                some = f.iloc[i : i + BOOKS]
                yield pd.DataFrame({"path": some["path"], "content": [applied(bytes(c), dict(n)) for c, n in zip(some["content"], some["new"], strict=True)]})

    return books.join(per, F.col("path") == F.col("book")).select("path", "content", "new").mapInPandas(run, "path string, content binary")


def with_metadata(content: bytes, title: str | None = None, language: str | None = None) -> bytes:
    """A book with another title (in its package and NCX) and language; what is not given or not there stays."""
    files = entries(content)
    opf, manifest, _ = _package(files)
    ncx = next((_path(opf, m["href"]) for m in manifest.values() if m["media_type"] == "application/x-dtbncx+xml"), None)

    def edit(file: str, change) -> None:
        for _, (prefix, uri) in XML.iterparse(io.BytesIO(files[file]), events=("start-ns",)):
            XML.register_namespace(prefix, uri)
        root = XML.fromstring(files[file])
        change(root)
        files[file] = XML.tostring(root, encoding="utf-8", xml_declaration=True)

    def package_(root: XML.Element) -> None:
        for name, value in (("title", title), ("language", language)):
            e = next((x for x in root.iter() if tag(x) == name), None)
            if value and e is not None:
                e.text = value

    def contents(root: XML.Element) -> None:
        e = next((x for d in root.iter() if tag(d) == "docTitle" for x in d if tag(x) == "text"), None)
        if e is not None:
            e.text = title

    edit(opf, package_)
    if title and ncx in files:
        edit(ncx, contents)
    return package(files)


def package(files: dict[str, bytes]) -> bytes:
    """A package: the media type first and stored, the rest by name and deflated; the same bytes for the
    same files."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in ["mimetype", *sorted(set(files) - {"mimetype"})]:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, files.get(name, b"application/epub+zip"))
    return out.getvalue()


def minimal_book(title: str, paragraphs: list[str]) -> bytes:
    """A book of one chapter from paragraphs' markup."""
    from html import escape

    body = "".join(paragraphs)
    return package(
        {
            "mimetype": b"application/epub+zip",
            "META-INF/container.xml": b'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
            "content.opf": f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></metadata><manifest><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine><itemref idref="c1"/></spine></package>'.encode(),
            "nav.xhtml": f'<html xmlns="http://www.w3.org/1999/xhtml"><body><nav><a href="c1.xhtml">{escape(title)}</a></nav></body></html>'.encode(),
            "c1.xhtml": f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(title)}</title></head><body>{body}</body></html>'.encode(),
        }
    )


def from_text(text: str, name: str) -> bytes:
    """A book of a plain text: paragraphs are parted by blank lines, and the first one's start is the title."""
    from html import escape

    found = [x.strip() for x in re.split(r"\n\s*\n", text) if x.strip()]
    return minimal_book(found[0][:80] if found else name, [f"<p>{escape(x)}</p>" for x in found])


_BLOCK = re.compile(r"<(?:p|h[1-6]|blockquote|ul|ol|li)[\s>/]", re.I)


def clean_fragment(html: str) -> str:
    """A page's body without scripts, styles and document-level tags; if it has no block of text then, all of its
    text as one paragraph."""
    from html import escape, unescape

    for pattern in (r"<script[^>]*>.*?</script>", r"<style[^>]*>.*?</style>", r"<!doctype[^>]*>", r"</?(?:html|head|body|meta|title|link)[^>]*>"):
        html = re.sub(pattern, "", html, flags=re.I | re.S)
    if _BLOCK.search(html):
        return html.strip()
    return f"<p>{escape(' '.join(unescape(re.sub('<[^>]+>', ' ', html)).split()))}</p>"


def from_html(html: str, name: str) -> bytes:
    """A book of a page. A fragment that is no well-formed XHTML becomes one paragraph of its text."""
    from html import escape, unescape

    inner = lambda t: next(iter(re.findall(rf"<{t}[^>]*>(.*?)</{t}>", html, re.I | re.S)), None)
    title = next((x for x in (inner("title"), inner("h1")) if x), name)
    body = clean_fragment(inner("body") or html)
    try:
        XML.fromstring(f"<x>{body}</x>")
    except XML.ParseError:
        body = f"<p>{escape(' '.join(unescape(re.sub('<[^>]+>', ' ', body)).split()))}</p>"
    return minimal_book(" ".join(unescape(re.sub("<[^>]+>", "", title)).split()), [body])


def applied(content: bytes, new: dict[str, str]) -> bytes:
    """A book with blocks (file::seq) replaced by new markup; every block of a file must be there."""
    files = entries(content)
    known = {f"{b[1]}::{b[3]:04d}": b for b in read_blocks(content)}
    if set(known) != set(new):
        raise ValueError(f"blocks differ: {sorted(set(known) ^ set(new))[:5]}")
    for file in {b[1] for b in known.values()}:
        root = XML.fromstring(files[file])
        parents = {c: p for p in root.iter() for c in p}
        body = next((e for e in root.iter() if tag(e) == "body"), root)
        targets = [e for e in body.iter() if tag(e) in TEXT_TAGS and prose("".join(e.itertext()))]
        for i, e in enumerate(targets, 1):
            fresh = XML.fromstring(new[f"{file}::{i:04d}"])
            space = e.tag.rpartition("}")[0]
            for x in fresh.iter():
                x.tag = f"{space}}}{x.tag}" if space else x.tag
            fresh.tail = e.tail
            p = parents[e]
            p[list(p).index(e)] = fresh
        XML.register_namespace("", "http://www.w3.org/1999/xhtml")
        files[file] = XML.tostring(root, encoding="utf-8", xml_declaration=True)
    return package(files)
