"""Document sources: binary files to text by extension, and where a document's content comes from.

Files are read by Spark's ``binaryFile`` source, so any store Spark can open works; parsing is one file at a time in a pandas UDF.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pdf import page_texts

ENCODINGS = ("utf-8", "latin-1", "cp1252", "utf-16")
EXTENSIONS = ("txt", "md", "docx", "pdf")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"
_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in ("text", "title", "author", "error")])


def decoded(data: bytes) -> str:
    """By the first encoding that fits; a UTF-16 byte order mark is believed before the single-byte encodings."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        try:
            return data.decode("utf-16")
        except UnicodeDecodeError:
            pass
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def docx_parts(data: bytes) -> dict:
    """Text with headings as ``#`` lines and tables as pipe lines, in document order, and title and author."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    lines = []
    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            text = _paragraph(block)
            style = block.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            level = name.removeprefix("Heading").strip()
            if text:
                lines.append(f"{'#' * int(level)} {text}" if name.startswith("Heading") and level.isdigit() and 1 <= int(level) <= 6 else text)
        elif block.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, map(_paragraph, cell.iter(f"{_W}p")))) for cell in row.findall(f"{_W}tc")] for row in block.findall(f"{_W}tr")]
            if rows:
                lines += [f"| {' | '.join(rows[0])} |", f"| {' | '.join('---' for _ in rows[0])} |", *(f"| {' | '.join(r)} |" for r in rows[1:])]
    told = {k: (core.findtext(f"{_DC}{tag}") if core is not None else None) for k, tag in (("title", "title"), ("author", "creator"))}
    return {"text": "\n".join(lines), **told, "error": None}


def _paragraph(p: ElementTree.Element) -> str:
    return "".join(x.text or "" if x.tag == f"{_W}t" else "\t" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab")).strip()


def pdf_text(data: bytes) -> str:
    """The texts of the pages that have any, with blank lines between."""
    return "\n\n".join(text for text in page_texts(data) if text.strip())


def parsed(extension: str, data: bytes) -> dict:
    out = {"text": None, "title": None, "author": None, "error": None}
    try:
        if extension in ("txt", "md"):
            return out | {"text": decoded(data)}
        if extension == "docx":
            return docx_parts(data)
        if extension == "pdf":
            return out | {"text": pdf_text(data)}
        return out | {"error": f"unsupported file type {extension!r}"}
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return out | {"error": f"{type(e).__name__}: {e}"}


@F.pandas_udf(_SCHEMA)
def parse_file(extension: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = [parsed(e, bytes(c)) for e, c in zip(extension, content, strict=True)]
    return pd.DataFrame(rows, columns=["text", "title", "author", "error"], dtype=object)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, extension, text, title, author, error`` of all files under a path. Files that cannot be read have an error and no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", extension.alias("extension"), parse_file(extension, "content").alias("p")).select("path", "extension", "p.*")


def valid_id(ident: Column) -> Column:
    return F.coalesce(ident.rlike("^[a-zA-Z0-9_-]+$"), F.lit(False))


def resolve_content(documents: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """``id, content, origin``: inline content, else the file, else stored content, else the PDF; ids must be well-formed.

    ``documents``: id, content, file_path, pdf_path; ``files``: path, text; ``stored``: id, content.
    """
    f = files.select("path", "text")
    rows = (
        documents.where(valid_id(F.col("id")))
        .join(f.select(F.col("path").alias("file_path"), F.col("text").alias("_file")), "file_path", "left")
        .join(stored.select("id", F.col("content").alias("_stored")), "id", "left")
        .join(f.select(F.col("path").alias("pdf_path"), F.col("text").alias("_pdf")), "pdf_path", "left")
    )

    def filled(c: str) -> Column:
        return F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.col(c))

    sources = (("content", "inline"), ("_file", "file"), ("_stored", "store"), ("_pdf", "pdf"))
    origin = F.coalesce(*[F.when(filled(c).isNotNull(), name) for c, name in sources])
    return rows.select("id", F.coalesce(*[filled(c) for c, _ in sources]).alias("content"), origin.alias("origin"))
