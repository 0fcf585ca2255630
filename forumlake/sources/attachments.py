"""Texts of attachments, and their chunks.

Files are read with Spark's binary source. Word documents and web pages are read
with the standard library; PDF files by a reader that is passed in, since none
is here; anything else is decoded with errors left out.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, language
from ..operators.chunking import by_sentences


#: Kinds of files by media type.
KINDS = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "text/html": "html", "text/plain": "txt"}


def text_of(content: bytes, name: str, read_pdf: Callable[[bytes], str] | None = None, media_type: str | None = None) -> str:
    """The text of one file, by its media type or else its name's extension; of PDF files by read_pdf."""
    import html

    kind = KINDS.get((media_type or "").split(";")[0].strip().lower(), name.rsplit(".", 1)[-1].lower())
    if kind == "docx":
        try:
            source = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8", "ignore")
        except (zipfile.BadZipFile, KeyError):
            return ""
        return html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", source))).strip()
    if kind == "pdf":
        return read_pdf(content) if read_pdf else ""
    text = content.decode("utf-8", "ignore")
    return html.unescape(re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]+>", " ", text)).strip() if kind in ("html", "htm") else text


def texts(spark: SparkSession, path: str, read_pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, name, text) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def read(frames: Iterator) -> Iterator:
        for frame in frames:
            yield frame[["path", "name"]].assign(text=[text_of(c, n, read_pdf) for c, n in zip(frame.content, frame.name)])

    return files.mapInPandas(read, "path string, name string, text string")


def pdf_words(spark: SparkSession, path: str, read: Callable[[bytes], list[list[tuple[str, float, float, float, float]]]]) -> DataFrame:
    """(doc, page, ord, text, x0, x1, top, bottom) of the PDF files below a folder, in the order of their text.

    read gives the words of each page of a file, since no reader of PDF files is here."""
    from .schemas import PDF_WORDS

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path).select(F.element_at(F.split("path", "/"), -1).alias("doc"), "content")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = [(doc, page, i, *word) for doc, content in zip(frame.doc, frame.content) for page, words in enumerate(read(content)) for i, word in enumerate(words)]
            yield pd.DataFrame(rows, columns=["doc", "page", "ord", "text", "x0", "x1", "top", "bottom"])

    return files.mapInPandas(run, PDF_WORDS)


def chunks(rows: DataFrame, budget: int = 500, carried: int = 8) -> DataFrame:
    """Chunks of attachments with their metadata; the language is the given one or guessed from the whole text."""
    own = [c for c in rows.columns if c not in ("text", "lang")]
    known = F.col("lang") if "lang" in rows.columns else F.lit(None).cast("string")
    found = rows.select(*own, language(F.col("text"), known).alias("lang"), F.posexplode(by_sentences(collapse(F.col("text")), budget, carried)).alias("chunk_index", "text"))
    return found.withColumn("text_length", F.length("text"))
