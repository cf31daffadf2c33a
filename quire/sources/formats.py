"""Input formats by file extension."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions by how they are read.
NATIVE, TEXT, HTML = (".epub",), (".txt",), (".html", ".htm", ".xhtml")
CONVERTED = (
    ".azw", ".azw3", ".azw4", ".cb7", ".cba", ".cbr", ".cbt", ".cbz", ".chm", ".docx", ".fb2", ".htmlz", ".kfx", ".lit", ".lrf", ".mobi", ".odt", ".pdb", ".pdf", ".pml", ".prc", ".rb",
    ".rtf", ".snb", ".tcr",
)


def extension(path: Column) -> Column:
    """The lower-case suffix of a path's last part, without query and fragment; empty where there is none."""
    name = F.element_at(F.split(F.regexp_replace(path, "[?#].*$", ""), "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[A-Za-z0-9]+)$", 1))


def conversion(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(*NATIVE), "native").when(e.isin(*TEXT), "internal-text").when(e.isin(*HTML), "internal-html").when(e.isin(*CONVERTED), "calibre").otherwise("unsupported")


def supported(spark: SparkSession) -> DataFrame:
    """(extension, conversion): everything that can be read, once each."""
    kinds = (("native", NATIVE), ("internal-text", TEXT), ("internal-html", HTML), ("calibre", CONVERTED))
    return spark.createDataFrame([(e, k) for k, es in kinds for e in es], "extension string, conversion string").dropDuplicates(["extension"])


def normalised_extension(value: Column, fallback: str = ".epub") -> Column:
    """A format's name as an extension in lower case with its dot."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(fallback))))
    v = F.coalesce(F.nullif(v, F.lit("")), F.lit(fallback))
    return F.when(F.startswith(v, F.lit(".")), v).otherwise(F.concat(F.lit("."), v))


#: Formats that a book can be written as.
OUTPUTS = (".epub", ".azw3", ".docx", ".fb2", ".html", ".htmlz", ".mobi", ".odt", ".pdf", ".rtf", ".txt")


def output_problem(path: Column, asked: Column) -> Column:
    """Why a book cannot be written to a path in a format; null where it can."""
    suffix = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[A-Za-z0-9]+)$", 1))
    e = normalised_extension(F.coalesce(F.nullif(asked, F.lit("")), F.nullif(suffix, F.lit(""))))
    return (
        F.when(~e.isin(*OUTPUTS), F.concat(F.lit("unsupported output format: "), e)).when(suffix == "", F.concat(F.lit("the path must end with "), e))
        .when(suffix != e, F.concat(F.lit("the path ends with "), suffix, F.lit(" but the format is "), e))
    )


#: Converts a file to another path: the two paths, and seconds it may take.
Converter = Callable[[Path, Path, float], None]


def timeout_seconds(value: float | str | None = None, default: float = 600.0) -> float:
    """Seconds for a conversion: as given, else of QUIRE_CONVERSION_TIMEOUT, else the default; more than 0."""
    raw = value if value is not None else os.environ.get("QUIRE_CONVERSION_TIMEOUT", "").strip() or default
    try:
        seconds = float(raw)
    except (TypeError, ValueError):
        seconds = 0.0
    if seconds <= 0:
        raise ValueError("a conversion's timeout must be a positive number of seconds")
    return seconds


def external(command: str | None = None, find: Callable[[str], str | None] = shutil.which, run: Callable = subprocess.run) -> Converter:
    """A converter that is a program of this machine: `command input output`. Without one, or with one that fails or
    takes too long, it raises ValueError."""

    def convert(source: Path, target: Path, seconds: float) -> None:
        program = command if command and Path(command).exists() else find(command or "ebook-convert")
        if not program:
            raise ValueError(f"{source.suffix} requires calibre: ebook-convert not found")
        try:
            done = run([program, str(source), str(target)], capture_output=True, text=True, timeout=seconds, check=False)
        except subprocess.TimeoutExpired as e:
            raise ValueError(f"ebook-convert timed out after {seconds:g} s") from e
        if done.returncode or not target.exists():
            raise ValueError(f"ebook-convert failed: {(done.stderr or done.stdout or '').strip()[:500]}")

    return convert


def book_of(name: str, content: bytes, converter: Converter | None = None, seconds: float | None = None) -> tuple[bytes, str]:
    """A file of any supported format as a book, and how it was made one."""
    from quire.sources.books import from_html, from_text

    e = Path(name).suffix.lower()
    if e in NATIVE:
        return content, "native"
    if e in TEXT:
        return from_text(content.decode("utf-8", "replace"), Path(name).stem), "internal-text"
    if e in HTML:
        return from_html(content.decode("utf-8", "replace"), Path(name).stem), "internal-html"
    if e not in CONVERTED:
        raise ValueError(f"unsupported input format: {e or '(no extension)'}")
    with tempfile.TemporaryDirectory() as d:  # the program works on files of its own machine, for this call only
        source, target = Path(d) / f"input{e}", Path(d) / "output.epub"
        source.write_bytes(content)
        (converter or external())(source, target, timeout_seconds(seconds))
        return target.read_bytes(), "calibre"


def as_books(spark: SparkSession, path: str, converter: Converter | None = None, seconds: float | None = None) -> DataFrame:
    """(path, conversion, book, error) of all files under a path."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = []
            for p, c in zip(f["path"], f["content"], strict=True):
                try:
                    book, how = book_of(p, bytes(c), converter, seconds)
                    rows.append((p, how, book, None))
                except ValueError as e:
                    rows.append((p, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "conversion", "book", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, conversion string, book binary, error string")
