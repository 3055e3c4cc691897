"""Tidying generated books: log noise, placeholder and repeated headers, titles of slugs, assembly of chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.text import TURNS, turns

# What a model's call log leaves in a text.
NOISE = (
    r"(?i)\[[0-9]{2}:[0-9]{2}:[0-9]{2}\][\t\n\f\r ]+(?:Ollama call (?:started|still running\.\.\.|completed)|Retrying Ollama call)[^\n\[]*",
    r"(?i)(?:Ollama call (?:started|still running\.\.\.|completed)[^\n]*|Retrying Ollama call[^\n]*)",
    r"(?i)[^.!?\n]*ollama call[^.!?\n]*(?:attempt[\t\n\f\r ]*[0-9]+/[0-9]+)?[^.!?\n]*[.!?]?",
    rf"(?i){T.EDGE}attempt[\t\n\f\r ]*[0-9]+/[0-9]+{T.EDGE}",
)
GENERIC = ("untitled", "untitled chapter", "unknown", "tbd", "")
HEADER = r"(?i)^#*[ \t]*chapter[ \t]+([0-9ivxlcdm]+)[ \t]*[:\-]?[ \t]*(.*)$"
AHEAD, TITLE_WORDS = 40, 8


def scrubbed(t: Column) -> Column:
    for pattern in NOISE:
        t = F.regexp_replace(t, pattern, " ")
    return t


def slug_title(stem: Column, given: Column | None = None) -> Column:
    """A book's given title, or its slug with blanks and a capital."""
    words = T.trimmed(F.replace(stem, F.lit("_"), F.lit(" ")))
    made = F.when(words == "", "Untitled").otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words))))
    return made if given is None else F.when(F.coalesce(T.trimmed(given), F.lit("")) != "", T.trimmed(given)).otherwise(made)


def generic(number: Column, title: Column) -> Column:
    t = F.lower(T.trimmed(title))
    return t.isin(*GENERIC) | (t == F.concat(F.lit("chapter "), F.lower(number))) | (t == F.concat(F.lit("ch "), F.lower(number))) | (t == F.concat(F.lit("ch. "), F.lower(number)))


def headers(lines: DataFrame) -> DataFrame:
    """lines(doc_id, pos, line) -> the headers that stay: doc_id, pos, number, title.

    A placeholder is skipped if a header of the same number with a better title follows within 40 lines, before one of another
    number; of headers in a row with one number only the first stays; a placeholder that stays takes its title from the first
    line below it, down to the next header, with three words or more.
    """
    rows = lines.withColumn("trim", T.trimmed(F.col("line")))
    rows = rows.withColumn("number", F.regexp_extract("trim", HEADER, 1)).withColumn("title", T.trimmed(F.regexp_extract("trim", HEADER, 2)))
    heads = rows.where("number <> ''").withColumn("generic", generic(F.col("number"), F.col("title")))
    w = Window.partitionBy("doc_id").orderBy("pos")
    better = F.when(~F.col("generic"), F.col("pos"))
    # the next better header, and the next of another number, by runs of equal numbers
    heads = heads.withColumn("new", F.coalesce((F.lower("number") != F.lag(F.lower("number")).over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    next_better = F.min(better).over(Window.partitionBy("doc_id", "run").orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    heads = heads.withColumn("skip", F.col("generic") & F.coalesce(next_better < F.col("pos") + AHEAD, F.lit(False))).where("NOT skip")
    heads = heads.withColumn("repeat", F.coalesce(F.lower("number") == F.lag(F.lower("number")).over(w), F.lit(False))).where("NOT repeat")
    first = F.regexp_replace(F.split("trim", "[.!?]", 2)[0], r"^[ \-:\t]+|[ \-:\t]+$", "")
    prose = rows.where("number = ''").select("doc_id", F.col("pos").alias("at"), T.find_all(first, "[A-Za-z0-9']+").alias("words")).where("size(words) >= 3")
    # each line belongs to the last header above it: one order of headers and lines, no range to join by
    mixed = prose.withColumn("head", F.lit(None).cast("int")).withColumn("wants", F.lit(None).cast("boolean")).unionByName(heads.select("doc_id", F.col("pos").alias("at"), F.lit(None).cast("array<string>").alias("words"), F.col("pos").alias("head"), F.col("generic").alias("wants")))
    above = Window.partitionBy("doc_id").orderBy("at")
    owned = mixed.select("doc_id", "at", "words", F.last("head", True).over(above).alias("pos"), F.last("wants", True).over(above).alias("wants"))
    wanted = owned.where("wants AND words IS NOT NULL")
    joined = F.array_join(F.slice("words", 1, TITLE_WORDS), " ")
    derived = wanted.groupBy("doc_id", "pos").agg(F.min_by(F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, F.lit(2), F.length(joined))), "at").alias("derived"))
    out = heads.join(derived, ["doc_id", "pos"], "left")
    return out.select("doc_id", "pos", "number", F.when(F.col("generic"), F.coalesce("derived", F.concat(F.lit("Chapter "), "number"))).otherwise(F.col("title")).alias("title"))


def assembled(titles: DataFrame, chaps: DataFrame) -> DataFrame:
    """(doc_id, title) and chapters -> doc_id, text: title and chapters in order, blank lines between."""
    texts = chaps.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chapter", "text"))).alias("x"))
    return titles.join(texts, "doc_id").select("doc_id", F.concat("title", F.lit("\n\n"), F.array_join("x.text", "\n\n")).alias("text"))


BLOB = "\n[12:34:56] Ollama call started model=x\nA line. Retrying Ollama call now\nBefore ollama call attempt 2/3 after. Then attempt 1/3 end.\n"


def corpus_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("doc_id", "chapter", F.md5(scrubbed(F.concat("text", F.lit(BLOB), "text"))).alias("text"))


def corpus_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a book's lines: a placeholder and, for every second chapter, a better header, then the text."""
    c = F.col("chapter")
    text = F.concat(F.lit("Chapter "), c, F.lit(": Untitled\n\n"), F.when(c % 2 == 0, F.concat(F.lit("Chapter "), c, F.lit(": The day "), c, F.lit("\n"))).otherwise(""), "text", F.lit("\nChapter "), c, F.lit(" - Again\n"))
    books = turns(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chapter", text.alias("text")))).alias("x"))
    lines = books.select("doc_id", F.posexplode(F.split(F.array_join("x.text", "\n"), "\n")).alias("pos", "line"))
    return headers(lines)


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    stem = F.replace(F.regexp_extract("url", "://([^/?#.]*)", 1), F.lit("-"), F.lit("_"))
    return rows.select("page_id", slug_title(stem, F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" T"), F.col("page_id").cast("string")))).alias("title"))


def assembled_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    chaps = turns(spark, sf_dir)
    names = chaps.select("doc_id").distinct().withColumn("title", F.concat(F.lit("Book "), F.col("doc_id").cast("string")))
    return assembled(names, chaps).withColumn("text", F.md5("text"))


def _sql_noise(x: str) -> str:
    for p in NOISE:
        x = f"regexp_replace({x}, '{p.replace(T.EDGE, chr(92) + 'b')}', ' ', 'g')"
    return x


_W = T.WIDE
_HEAD = r"(?i)^#*[ \t]*chapter[ \t]+([0-9ivxlcdm]+)[ \t]*[:\-]?[ \t]*(.*)$"
SQL_HEADERS = rf"""
WITH b AS (SELECT doc_id, string_agg('Chapter ' || chapter || ': Untitled' || chr(10) || chr(10) || CASE WHEN chapter % 2 = 0 THEN 'Chapter ' || chapter || ': The day ' || chapter || chr(10) ELSE '' END || text || chr(10) || 'Chapter ' || chapter || ' - Again' || chr(10), chr(10) ORDER BY chapter) AS t FROM {TURNS} GROUP BY doc_id),
l AS (SELECT doc_id, (i - 1)::INT AS pos, regexp_replace(ls[i], '^{_W}+|{_W}+\z', '', 'g') AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS ls, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM b)),
p AS (SELECT *, regexp_extract(line, '{_HEAD}', 1) AS number, regexp_replace(regexp_extract(line, '{_HEAD}', 2), '^{_W}+|{_W}+\z', '', 'g') AS title FROM l),
h AS (SELECT doc_id, pos, number, title, lower(title) IN ('untitled', 'untitled chapter', 'unknown', 'tbd', '', 'chapter ' || lower(number), 'ch ' || lower(number), 'ch. ' || lower(number)) AS generic FROM p WHERE number <> ''),
k AS (SELECT h.* FROM h WHERE NOT (generic AND EXISTS (SELECT 1 FROM h x WHERE x.doc_id = h.doc_id AND x.pos > h.pos AND x.pos < h.pos + 40 AND NOT x.generic AND lower(x.number) = lower(h.number)
  AND NOT EXISTS (SELECT 1 FROM h y WHERE y.doc_id = h.doc_id AND y.pos > h.pos AND y.pos < x.pos AND lower(y.number) <> lower(h.number))))),
u AS (SELECT *, lag(lower(number)) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM k),
s AS (SELECT doc_id, pos, number, title, generic, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), 2147483647) AS til FROM u WHERE prev IS NULL OR prev <> lower(number)),
w AS (SELECT doc_id, pos AS wp, regexp_extract_all(regexp_replace(regexp_split_to_array(line, '[.!?]')[1], '^[ \-:\t]+|[ \-:\t]+$', '', 'g'), '[A-Za-z0-9'']+') AS ws FROM p WHERE number = ''),
d AS (SELECT s.doc_id, s.pos, arg_min(array_to_string(ws[1:8], ' '), wp) AS t FROM s JOIN w ON w.doc_id = s.doc_id AND wp > s.pos AND wp < til AND len(ws) >= 3 WHERE generic GROUP BY s.doc_id, s.pos)
SELECT s.doc_id, s.pos, number, CASE WHEN generic THEN coalesce(upper(d.t[1:1]) || d.t[2:], 'Chapter ' || number) ELSE title END AS title FROM s LEFT JOIN d ON d.doc_id = s.doc_id AND d.pos = s.pos"""
_blob = "'" + BLOB.replace("\n", "' || chr(10) || '") + "'"
QUERIES = {"corpus_scrubbed": corpus_scrubbed, "corpus_headers": corpus_headers, "slug_titles": slugs, "assembled_books": assembled_books}
ORACLES = {
    "corpus_scrubbed": f"SELECT doc_id, chapter, md5({_sql_noise('text || ' + _blob + ' || text')}) AS text FROM {TURNS}",
    "slug_titles": "WITH s AS (SELECT page_id, trim(replace(regexp_extract(url, '://([^/?#.]*)', 1), '-', ' ')) AS w FROM pages) SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'T' || page_id WHEN w = '' THEN 'Untitled' ELSE upper(w[1:1]) || w[2:] END AS title FROM s",
    "corpus_headers": SQL_HEADERS,
    "assembled_books": f"SELECT doc_id, md5('Book ' || doc_id || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY chapter)) AS text FROM {TURNS} GROUP BY doc_id",
}
