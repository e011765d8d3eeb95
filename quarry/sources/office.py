"""Word documents: paragraphs as lines, table rows as cells joined by bars. A zip of XML has no built-in reader, so Python reads it."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{WORD}t")).strip()


def docx_lines(content: bytes | None) -> str | None:
    """None for what is no readable document."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content or b"")).read("word/document.xml")).find(f"{WORD}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = []
    for node in body if body is not None else []:
        if node.tag == f"{WORD}p":
            lines.append(_text(node))
        elif node.tag == f"{WORD}tbl":
            lines += [" | ".join(_text(c) for c in row.iter(f"{WORD}tc")) for row in node.iter(f"{WORD}tr")]
    return "\n".join(x for x in lines if x)


@F.udf(T.StringType(), useArrow=True)
def docx_text(content):
    return docx_lines(content)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """document and text of the .md, .txt and .docx files of a folder."""
    from quarry.sources.tables import decoded

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{md,txt,docx}").load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("document"), "content")
    word = F.col("document").endswith(".docx")
    return decoded(files.filter(~word)).unionByName(files.filter(word).select("document", docx_text("content").alias("text")))
