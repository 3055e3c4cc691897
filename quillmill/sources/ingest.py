"""Reading manuscripts: DOCX, PDF and text files, chapter folders, metadata, pasted text; a file that cannot be read is a row with an error."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.text import TURNS, turns
from . import pdf
from .corpus import slug_title

UNSUPPORTED = "unsupported file type"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The text runs of a word-processing package, a line per paragraph."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/document.xml" not in z.namelist():
            raise ValueError("word/document.xml is missing")
        parts: list[str] = []
        for event, node in ElementTree.iterparse(io.BytesIO(z.read("word/document.xml")), events=("start", "end")):
            name = node.tag.rpartition("}")[2]
            if event == "start" and name == "p" and parts:
                parts.append("\n")
            elif event == "end" and name == "t" and node.text:
                parts.append(node.text)
        return "".join(parts)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path -> path, title, kind, page, text, error: a row for each page of a PDF, one for any other file.

    A page that cannot be read is a row without text; a file that cannot be read is one row with an error.
    """

    def parts(kind: str, content: bytes) -> list[tuple[int, str | None, str | None]]:
        try:
            if kind == "docx":
                return [(1, docx_text(content), None)]
            if kind == "pdf":
                return [(i, t, None) for i, t in enumerate(pdf.pages(content), 1)] or [(1, None, "no text")]
            return [(1, None, UNSUPPORTED)]
        except Exception as e:  # a broken file is a row, not a failed job
            return [(1, None, f"{type(e).__name__}: {e}")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a file's pages are a batch, so no two files are held as text
                name, title, kind, content = (batch.column(c)[at].as_py() for c in ("path", "title", "kind", "content"))
                found = parts(kind, content)
                columns = [[name] * len(found), [title] * len(found), [kind] * len(found), *map(list, zip(*found))]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, [pa.string()] * 3 + [pa.int32()] + [pa.string()] * 2)], names=["path", "title", "kind", "page", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("kind"), "content")
    return files.mapInArrow(task, "path string, title string, kind string, page int, text string, error string")


def read_files(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    """Files below a path -> doc_id, title, path, lang, text, error; a PDF's pages are joined in order, those that cannot be read are left out."""
    rows = read_pages(spark, path).groupBy("path", "title").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"), F.max("error").alias("failed"))
    joined = F.array_join(F.transform(F.filter("pages", lambda p: p["text"].isNotNull()), lambda p: p["text"]), "\n")
    text = T.lines_tidied(joined)
    error = F.when(F.col("failed").isNotNull(), F.col("failed")).when(text == "", F.lit("no text"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "title", "path", F.lit(lang).alias("lang"), F.coalesce(text, F.lit("")).alias("text"), error.alias("error"))


def read_text(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    """Plain-text manuscripts, one per file; the text is kept as it is, so blank lines count as paragraph breaks."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    title = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return rows.select(F.xxhash64("path").alias("doc_id"), title.alias("title"), "path", F.lit(lang).alias("lang"), F.col("value").alias("text"))


def excerpt(spark: SparkSession, text: str, lang: str = "en") -> DataFrame:
    """One pasted text, trimmed and otherwise as it is."""
    return spark.createDataFrame([(1, "Pasted Excerpt", "source.txt", lang, text.strip())], "doc_id long, title string, path string, lang string, text string")


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """A tree of <book>_chapters/chapter_NNN.txt -> book, chapter, text."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="chapter_*.txt")
    where = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(where, r"([^/]+?)(?:_chapters)?/chapter_[0-9]+\.txt$", 1).alias("book"), F.regexp_extract(where, r"chapter_([0-9]+)\.txt$", 1).cast("int").alias("chapter"), F.col("value").alias("text"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A tree of <book>.meta.json -> book, title, genre, model, endpoint, total_words, target_min_words, book_file, generated_at; what a file lacks is null, as is all of a broken one."""
    schema = "title string, genre string, model string, endpoint string, total_words long, target_min_words long, book_file string, generated_at string"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").json(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.meta\.json$", 1).alias("book"), "*")


def read_books(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    """Chapters below a path with their books' metadata -> doc_id, title, genre, lang, text: chapters in order, blank lines between; a book without metadata has its slug's title."""
    return books(read_chapters(spark, path), read_metadata(spark, path), lang)


def books(chapters: DataFrame, metadata: DataFrame, lang: str = "en") -> DataFrame:
    """chapters(book, chapter, text), metadata(book, title, genre) -> doc_id, book, title, genre, lang, n_chapters, text."""
    texts = chapters.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("chapter", "text"))).alias("x"))
    named = metadata.groupBy("book").agg(F.max("title").alias("given"), F.max("genre").alias("genre"))
    rows = texts.join(named, "book", "left")
    return rows.select(F.xxhash64("book").alias("doc_id"), "book", slug_title(F.col("book"), F.col("given")).alias("title"), "genre", F.lit(lang).alias("lang"), F.size("x").alias("n_chapters"), F.array_join("x.text", "\n\n").alias("text"))


def book_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books, metadata for two of three: their titles, genres and texts."""
    rows = turns(spark, sf_dir)
    chapters = rows.select(F.concat(F.lit("the_book_"), "doc_id").alias("book"), "chapter", "text")
    told = rows.where("doc_id % 3 > 0 AND chapter = 1").select(F.concat(F.lit("the_book_"), "doc_id").alias("book"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" Tale "), "doc_id")).alias("title"), F.lit("mystery").alias("genre"))
    return books(chapters, told).select("book", "title", "genre", "n_chapters", F.md5("text").alias("text"))


QUERIES = {"book_metadata": book_metadata}
ORACLES = {
    "book_metadata": f"SELECT 'the_book_' || doc_id AS book, CASE WHEN doc_id % 3 = 1 AND bool_or(chapter = 1) THEN 'Tale ' || doc_id ELSE 'The book ' || doc_id END AS title, CASE WHEN doc_id % 3 > 0 AND bool_or(chapter = 1) THEN 'mystery' END AS genre, count(*)::INT AS n_chapters, md5(string_agg(text, chr(10) || chr(10) ORDER BY chapter)) AS text FROM {TURNS} GROUP BY doc_id"
}
