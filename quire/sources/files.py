"""Readers of document files: text with an encoding fallback and EPUB, by Spark's binary file source."""

from __future__ import annotations

import io
import re
import zipfile
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

SUFFIXES = (".epub", ".txt", ".md", ".markdown")


def decode(data: bytes) -> str:
    """UTF-8, else Windows-1252, else Latin-1, which takes any byte."""
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def epub_pages(data: bytes) -> list[str]:
    """S3: the text of each chapter in reading order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = re.search(r'full-path="([^"]+)"', z.read("META-INF/container.xml").decode())[1]
        package, folder = z.read(root).decode(), root.rpartition("/")[0]
        items = {}
        for tag in re.findall(r"<item\b[^>]*>", package):
            field = dict(re.findall(r'([\w-]+)="([^"]*)"', tag))
            items[field["id"]] = field["href"]
        out = []
        for ref in re.findall(r'<itemref\b[^>]*idref="([^"]+)"', package):
            html = z.read(f"{folder}/{items[ref]}" if folder else items[ref]).decode("utf-8", "replace")
            body = re.sub(r"(?is)<(script|style|head)\b.*?</\1>", "", html)
            body = re.sub(r"(?i)</(p|h\d|li|div)>", "\n\n", body)
            out.append(unescape(re.sub(r"<[^>]+>", "", body)).strip())
        return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_index, text) of all supported files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    chosen = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*SUFFIXES)).select("path", "content")

    def pages(batches):
        for pdf in batches:
            rows = []
            for p, c in zip(pdf.path, pdf.content, strict=True):
                texts = epub_pages(c) if p.lower().endswith(".epub") else decode(c).split("\f")
                rows += [(p, i, x) for i, x in enumerate(texts)]
            yield pd.DataFrame(rows, columns=["path", "page_index", "text"])

    return chosen.mapInPandas(pages, "path string, page_index int, text string")
