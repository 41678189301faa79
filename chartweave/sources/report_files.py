"""Report folders: DOCX and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "filename string, file_size_bytes long, text string"


def _paragraphs(content: bytes) -> str:
    """Trimmed non-blank body paragraphs of a DOCX file; unreadable gives ''."""
    import io
    import zipfile
    from xml.etree import ElementTree

    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{ns}body")
        lines = []
        for p in body.findall(f"{ns}p"):
            parts = []
            for node in p.iter():
                if node.tag == f"{ns}t":
                    parts.append(node.text or "")
                elif node.tag == f"{ns}tab":
                    parts.append("\t")
                elif node.tag in (f"{ns}br", f"{ns}cr"):
                    parts.append("\n")
            line = "".join(parts).strip()
            if line:
                lines.append(line)
        return "\n".join(lines)
    except Exception:
        return ""


def _decode(batches):
    import pandas as pd

    for pdf in batches:
        texts = [
            _paragraphs(bytes(c)) if name.lower().endswith(".docx") else bytes(c).decode("utf-8", "replace")
            for name, c in zip(pdf["filename"], pdf["content"])
        ]
        yield pd.DataFrame(
            {"filename": pdf["filename"], "file_size_bytes": pdf["file_size_bytes"], "text": texts}
        )


def read_reports(spark: SparkSession, folder: str, kind: str = "docx", min_chars: int = 0) -> DataFrame:
    """``(filename, file_size_bytes, text)`` of a folder of reports.

    Office lock files are skipped. Files are decoded in Arrow batches on the
    executors that list them; texts shorter than ``min_chars`` are dropped.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(folder)
    named = rows.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size_bytes"), "content"
    ).where(~F.col("filename").startswith("~$"))
    decoded = named.withColumn("filename", F.url_decode("filename")).mapInPandas(_decode, SCHEMA)
    return decoded.where(F.length("text") >= min_chars)
