"""Text of files from their bytes; a file that can't be read gives null, never an error."""

from __future__ import annotations

import importlib.util
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES, MOST_CHARS, NUL_WITHIN = 8_000_000, 2_000_000, 8192
DECODERS = ("utf-8-sig", "utf-16", "cp1252", "latin-1")  # fixed values: tried in this order; the last takes any bytes
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}


def decoded(data: bytes, name: str) -> str | None:
    try:
        return data.decode(name)
    except UnicodeDecodeError:
        return None


def plain(data: bytes) -> str | None:
    """Decoded text; null if a NUL byte stands early."""
    if data.find(b"\0", 0, NUL_WITHIN) >= 0:
        return None
    tried = (decoded(data[:MOST_BYTES], name) for name in DECODERS)
    return next(text for text in tried if text is not None)[:MOST_CHARS]


def clipped(text: str) -> str | None:
    """Text of a rich format: without outer white space, up to the limit; null for none."""
    return text.strip()[:MOST_CHARS] or None


def run_text(node: ElementTree.Element) -> str:
    """Text of a paragraph or cell, with the tabs and line breaks of its runs."""
    return "".join(_MARKS.get(t.tag, t.text or "") for t in node.iter() if t.tag == f"{_W}t" or t.tag in _MARKS)


def docx(data: bytes) -> str | None:
    """Paragraphs, then table rows with cells joined by tabs; blank parts dropped."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    paragraphs = [run_text(p) for p in body.findall(f"{_W}p")]
    cells = ["\t".join("\n".join(map(run_text, cell.findall(f"{_W}p"))) for cell in row.findall(f"{_W}tc")) for row in body.iterfind(f"{_W}tbl/{_W}tr")]
    return clipped("\n".join(filter(str.strip, paragraphs + cells)))


def pdf(data: bytes) -> str | None:
    """Page texts with a blank line between them; null if encrypted, empty, or without a PDF library. Pages beyond the limit aren't read."""
    if importlib.util.find_spec("pypdf") is None:
        return None
    document = importlib.import_module("pypdf").PdfReader(io.BytesIO(data))
    if document.is_encrypted:
        return None
    with io.StringIO() as text:
        for page in document.pages:
            if text.tell() > MOST_CHARS:
                break
            text.write("\n\n" * (text.tell() > 0) + (page.extract_text() or ""))
        return clipped(text.getvalue())


def text_of(path: str | None, data: bytes | None) -> str | None:
    if data is None:
        return None
    kind = re.search(r"\.[^./]+$", (path or "").lower())
    try:
        return {".pdf": pdf, ".docx": docx}.get(kind[0] if kind else "", plain)(data)
    except Exception:  # noqa: BLE001  a broken file must not fail the run
        return None


@F.pandas_udf(T.StringType())
def extract_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """extract_text(path, content): text of each file."""
    for paths, contents in batches:
        yield pd.Series([text_of(p, c) for p, c in zip(paths, contents)], dtype=object)
