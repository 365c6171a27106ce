"""Files as text segments.

A listing of paths is made on the driver, as hidden and temporary files need
rules of their own; contents are read and taken apart by the executors.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.records import flatten
from quillspan.profiles import EXTENSIONS

# Folders that are never searched, and the size above which a batch of files is refused.
IGNORED_FOLDERS = frozenset((".git", "__pycache__", ".venv", "node_modules", "$RECYCLE.BIN", "System Volume Information"))
LARGEST_FILE = 45 * 1024 * 1024

LISTING = "source_path string, relative_path string, source_name string, extension string, size bigint, mtime_ns bigint"
SEGMENTS = "source_path string, seg_idx int, text string, location string, metadata map<string,string>, url string, error string"


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The documents below a folder: no ignored or dotted folders, no lock files (``~$``), known extensions only."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    root = os.path.abspath(root)
    rows = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in IGNORED_FOLDERS and not d.startswith("."))
        for name in sorted(names):
            extension = os.path.splitext(name)[1].lower()
            if name.startswith("~$") or extension not in extensions:
                continue
            path = os.path.join(folder, name)
            info = os.stat(path)
            rows.append((path, os.path.relpath(path, root), name, extension, info.st_size, info.st_mtime_ns))
    rows.sort(key=lambda r: (r[4], r[0].lower()))
    return spark.createDataFrame(rows, LISTING)


def refuse_large(listing: DataFrame, most: int = LARGEST_FILE) -> DataFrame:
    """The listing itself, unless a file is too large: then none of it is read."""
    large = listing.filter(F.col("size") > most).select("source_name").first()
    if large:
        raise ValueError(f"{large.source_name} is larger than {most} bytes")
    return listing


def decode(raw: bytes) -> str:
    """UTF-8, else Windows-1252, else Latin-1, with line ends as \\n."""
    for encoding in ("utf-8", "cp1252", "latin-1"):
        try:
            return raw.decode(encoding).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    return ""


def _squeezed_lines(text: str) -> str:
    return "\n".join(x for x in (" ".join(line.split()) for line in text.splitlines()) if x)


Segment = tuple[str, str, dict | None, str | None]


def plain_segments(text: str) -> list[Segment]:
    out, line = [], 1
    for block in text.split("\n\n"):
        clean = _squeezed_lines(block)
        if clean:
            out.append((clean, f"linea {line}", None, None))
        line += block.count("\n") + 2
    return out


def block_segments(text: str) -> list[Segment]:
    out, line = [], 1
    text = text.replace("\r\n", "\n").strip()
    for block in re.split(r"\n\s*\n", text) if text else []:
        clean = " ".join(block.split())
        if clean:
            out.append((clean, f"línea {line}", None, None))
        line += block.count("\n") + 2
    return out


def rtf_text(text: str, escapes: bool = True) -> str:
    """The text between control words; the web profile doesn't know escaped signs."""
    text = re.sub(r"\\[a-zA-Z]+-?\d* ?", " ", re.sub(r"\\'[0-9a-fA-F]{2}", " ", text))
    for escaped, plain in ((r"\{", "{"), (r"\}", "}"), ("\\\\", "\\")) if escapes else ():
        text = text.replace(escaped, plain)
    return re.sub(r"[{}]", " ", text)


class _Body(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.head, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.head += tag == "head"

    def handle_endtag(self, tag):
        self.head -= tag == "head" and self.head > 0

    def handle_data(self, data):
        if not self.head:
            self.parts.append(data)


def markup_text(text: str) -> str:
    body = _Body()
    body.feed(text)
    body.close()
    return "".join(body.parts)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_segments(raw: bytes) -> list[Segment]:
    """Paragraphs, numbered with the empty ones, then tables."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def said(node) -> str:
        return "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in node.iter())

    out: list[Segment] = []
    for i, p in enumerate(body.findall(f"{_W}p"), 1):
        text = _squeezed_lines(said(p))
        if text:
            out.append((text, f"parrafo {i}", None, None))
    for i, t in enumerate(body.findall(f"{_W}tbl"), 1):
        cells = [[_squeezed_lines("\n".join(said(p) for p in c.findall(f"{_W}p"))) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
        rows = [" | ".join(filter(None, row)) for row in cells if any(row)]
        if rows:
            out.append(("\n".join(rows), f"tabla {i}", None, None))
    return out


def docx_blocks(raw: bytes) -> list[Segment]:
    """Paragraphs and cells in the order of the document, as blocks."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda x: "\t", f"{_W}br": lambda x: "\n"}
    paragraphs = ["".join(text[x.tag](x) for x in p.iter() if x.tag in text) for p in body.iter(f"{_W}p")]
    return block_segments("\n\n".join(paragraphs))


def record_segments(records: list, offset: int) -> list[Segment]:
    out: list[Segment] = []
    for i, record in enumerate(records):
        entries = [(k, v) for k, v in flatten(record) if v.strip()]
        if not entries:
            continue
        url = next((v for k, v in entries if re.search("url|link|enlace", k.lower()) and re.match("https?://", v, re.IGNORECASE)), None)
        out.append(("\n".join(f"{k}: {v}" for k, v in entries), f"fila {i + offset}", dict(entries[:18]), url))
    return out


def delimited_segments(text: str, separator: str) -> list[Segment]:
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=separator) if any(c.strip() for c in r)]
    if not rows:
        return []
    header: list[str] = []
    for name in (h.strip() or "columna" for h in rows[0]):
        again = sum(h == name or h.startswith(f"{name}_") for h in header)
        header.append(f"{name}_{again}" if name in header else name)
    # what a row has beyond the header comes under one further key
    records = [dict(zip(header, r)) | ({"__parsed_extra": r[len(header) :]} if len(r) > len(header) else {}) for r in rows[1:]]
    return record_segments(records, 2)


def json_segments(text: str) -> list[Segment]:
    value = json.loads(text)
    if isinstance(value, list):
        return record_segments(value, 1)
    if isinstance(value, dict):
        inner = next((v for v in value.values() if isinstance(v, list)), None)
        return record_segments(inner if inner is not None else [value], 1)
    return [(dict(flatten(value)).get("valor", "null"), "valor JSON", None, None)]


def json_lines_segments(text: str) -> list[Segment]:
    values = []
    for i, line in enumerate((x for x in text.splitlines() if x.strip()), 1):
        try:
            values.append(json.loads(line))
        except ValueError as e:
            raise ValueError(f"line {i} is no JSON") from e
    return record_segments(values, 1)


def _pages_by_fitz(raw: bytes) -> list[str]:
    import fitz

    with fitz.open(stream=raw, filetype="pdf") as doc:
        return [p.get_text("text") for p in doc]


def _pages_by_pypdf(raw: bytes) -> list[str]:
    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages]


def pdf_pages(raw: bytes) -> list[str]:
    """The text of a PDF's pages; needs one of the optional libraries. What the first one fails of is read by the second."""
    try:
        return _pages_by_fitz(raw)
    except Exception:
        try:
            return _pages_by_pypdf(raw)
        except ImportError as e:
            raise RuntimeError("reading PDF needs PyMuPDF or pypdf") from e


def pdf_segments(raw: bytes) -> list[Segment]:
    return [(clean, f"pagina {i}", None, None) for i, t in enumerate(pdf_pages(raw), 1) if (clean := _squeezed_lines(t))]


#: A page with fewer letters and digits counts as a picture of text.
LEAST_LETTERS = 40


def pdf_page_segments(raw: bytes) -> list[Segment]:
    """The pages that have a text of their own; an error if none has. Pictures of text are for ``merged_ocr``."""
    pages = ((i, " ".join(t.split())) for i, t in enumerate(pdf_pages(raw), 1))
    found = [(t, f"página {i}", None, None) for i, t in pages if sum(c.isalnum() for c in t) >= LEAST_LETTERS]
    if not found:
        raise ValueError("no page has a text of its own; its pages need recognition")
    return found


READERS: dict[str, dict[str, Callable[[bytes], list[Segment]]]] = {
    "desktop": {
        ".pdf": pdf_segments,
        ".docx": docx_segments,
        ".txt": lambda raw: plain_segments(decode(raw)),
        ".md": lambda raw: plain_segments(decode(raw)),
        ".rtf": lambda raw: [(t, "contenido rtf", None, None) for t in [_squeezed_lines(rtf_text(decode(raw)))] if t],
    },
    "web": {
        ".pdf": pdf_page_segments,
        ".docx": docx_blocks,
        ".txt": lambda raw: block_segments(decode(raw)),
        ".md": lambda raw: block_segments(decode(raw)),
        ".rtf": lambda raw: block_segments(" ".join(rtf_text(decode(raw), escapes=False).split())),
        ".html": lambda raw: block_segments(markup_text(decode(raw))),
        ".htm": lambda raw: block_segments(markup_text(decode(raw))),
        ".xml": lambda raw: block_segments(markup_text(decode(raw))),
        ".csv": lambda raw: delimited_segments(decode(raw), ","),
        ".tsv": lambda raw: delimited_segments(decode(raw), "\t"),
        ".json": lambda raw: json_segments(decode(raw)),
        ".jsonl": lambda raw: json_lines_segments(decode(raw)),
        ".ndjson": lambda raw: json_lines_segments(decode(raw)),
    },
}


def _taken_apart(path: str, profile: str, content: Callable[[], bytes]) -> list[tuple]:
    """The rows of SEGMENTS of one file; a row with the error if it can't be read."""
    reader = READERS[profile].get(os.path.splitext(path)[1].lower())
    if reader is None:
        return [(path, None, None, None, None, None, "unsupported file")] if profile == "web" else []
    try:
        return [(path, i, t, where, m, u, None) for i, (t, where, m, u) in enumerate(reader(content()))]
    except Exception as e:  # a broken file must not stop the others
        return [(path, None, None, None, None, None, f"{type(e).__name__}: {e}")]


def _segment_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])
    frame["seg_idx"] = frame["seg_idx"].astype("Int32")
    return frame


def read_segments(listing: DataFrame, profile: str = "desktop") -> DataFrame:
    """The segments of every listed file; a file that can't be read gives one row with its error.

    Unknown extensions give nothing in the desktop profile and an error in the
    web one, which refuses the whole listing if a file is too large.
    """
    if profile == "web":
        listing = refuse_large(listing)

    def content_of(path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _segment_frame([r for path in batch["source_path"] for r in _taken_apart(path, profile, lambda: content_of(path))])  # noqa: B023

    return listing.select("source_path").mapInPandas(read, SEGMENTS)


def content_segments(files: DataFrame, profile: str = "desktop") -> DataFrame:
    """As ``read_segments``, of contents at hand: (source_path, content), as Spark's own source of binary files has them."""
    if profile == "web":
        refuse_large(files.select(F.col("source_path").alias("source_name"), F.length("content").alias("size")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _segment_frame([r for path, raw in zip(batch["source_path"], batch["content"]) for r in _taken_apart(path, profile, lambda: bytes(raw))])  # noqa: B023

    return files.select("source_path", "content").mapInPandas(read, SEGMENTS)


def mirrored(listing: DataFrame, target: str, tries: int = 3) -> DataFrame:
    """(source_path, target_path, error): every listed file copied below ``target``, where its size or time differs from the copy.

    Nothing is deleted there. A copy is complete or isn't there at all; a file
    that can't be copied after ``tries`` attempts gives its error.
    """

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, relative in zip(batch["source_path"], batch["relative_path"]):
                at, error = os.path.join(target, relative), None
                for _ in range(tries):
                    try:
                        a = os.stat(path)
                        b = os.stat(at) if os.path.exists(at) else None
                        if b is None or (a.st_size, int(a.st_mtime)) != (b.st_size, int(b.st_mtime)):
                            os.makedirs(os.path.dirname(at), exist_ok=True)
                            part = f"{at}.{uuid.uuid4().hex}.part"
                            shutil.copy2(path, part)
                            os.replace(part, at)
                        error = None
                        break
                    except OSError as e:
                        error = f"{type(e).__name__}: {e}"
                out.append((path, at, error))
            yield pd.DataFrame(out, columns=["source_path", "target_path", "error"])

    return listing.select("source_path", "relative_path").mapInPandas(copy, "source_path string, target_path string, error string")


def pasted_source(spark: SparkSession, name: str, text: str) -> DataFrame:
    """Pasted text as segments of a source."""
    name = name.strip() or "Texto pegado"
    rows = [(name, "texto pegado", i, t, where) for i, (t, where, _, _) in enumerate(block_segments(text))]
    return spark.createDataFrame(rows, "source_name string, source_type string, seg_idx int, text string, location string")


def merged_ocr(pages: DataFrame, recognised: DataFrame, source: str = "source_id") -> DataFrame:
    """Pages with recognised text where their own is too poor; pages without either are left out.

    ``pages`` has the source, page_number and text, ``recognised`` the source,
    page_number, text and confidence.
    """
    from quillspan.functions.text import js_squeezed, normalize_ocr, page_needs_ocr

    r = recognised.select(source, "page_number", normalize_ocr("text").alias("__ocr"), "confidence")
    x = pages.join(r, [source, "page_number"], "left").withColumn("__poor", page_needs_ocr("text"))
    text = F.when(F.col("__poor"), F.nullif(F.col("__ocr"), F.lit(""))).otherwise(js_squeezed("text"))
    label = F.concat(F.lit("página "), F.col("page_number").cast("string"), F.when(F.col("__poor"), " · OCR").otherwise(""))
    metadata = F.when(F.col("__poor"), F.create_map(F.lit("extracción"), F.lit("OCR local")))
    return x.withColumn("text", text).filter("text is not null").withColumn("location", label).withColumn("metadata", metadata).drop("__ocr", "__poor")


def render_scale(width: F.Column, height: F.Column) -> F.Column:
    """How much a page is enlarged before recognition."""
    return F.greatest(F.lit(1.2), F.least(F.lit(2.0), F.sqrt(F.lit(6e6) / (width * height))))
