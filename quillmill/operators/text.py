"""Tokens, normal forms, sentences, segments, windows, chapters and samples of manuscripts: projections without a shuffle."""

from __future__ import annotations

import weakref
from collections import deque

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

NUMBERS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
#: A chapter header anywhere in the text, and as a line of its own.
INLINE = rf"(?i)(?=c){T.BEGIN}(chapter|ch\.)[\t\n\f\r ]+([0-9ivxlcdm]+|{NUMBERS}){T.END}"
LINE = rf"(?i)^[\t\n\f\r ]*(chapter|ch\.)[\t\n\f\r ]+([0-9ivxlcdm]+|{NUMBERS}){T.END}.*"
#: Opens a chapter or block; itself taken out of texts first.
MARK = "\u0001"
SEGMENT, OVERLAP, CHUNK = 1500, 200, 2500
VOWEL, CLUSTER = "[aeiouy]", "[bcdfghjklmnpqrstvwxz]{6,}"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))


#: Bytes of a file to a partition, where rows are dealt out.
SPREAD = 16 << 20


def dealt(table: DataFrame) -> DataFrame:
    """Rows of a table whose files give fewer tasks than there are cores, dealt out: a row group is read by one task. As many partitions as cores, more for large files; other tables stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    if len(table.inputFiles()) >= cores:
        return table
    held = table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.spark_partition_id().alias("task")).distinct().collect()
    if len({r.task for r in held}) >= cores:
        return table
    return table.repartition(max(cores, -(-sum({r.file: r.size for r in held}.values()) // SPREAD)))


#: Shared tables that nothing uses any more.
_unused: deque[DataFrame] = deque()


def kept(table: DataFrame) -> DataFrame:
    """A table that several others are built on: computed once, in memory and then on disk; a lost executor's part is computed again.

    What releases() has marked is let go here, for a finaliser may run while another call to the JVM is under way.
    """
    while _unused:
        _unused.popleft().unpersist()
    return table.persist(StorageLevel.MEMORY_AND_DISK)


def filled(table: DataFrame) -> DataFrame:
    """A kept() table, computed at once: where several stages that read it begin together, two executors would each compute the same part."""
    table.count()
    return table


def releases(result, *tables: DataFrame):
    """result; when it is no longer used its kept() tables are marked to be let go. What was derived from it goes on without them, from the files."""
    for table in tables:
        weakref.finalize(result, _unused.append, table).atexit = False
    return result


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as manuscripts: a turn is a chapter."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    chapter = (F.col("turn") + 1).cast("int")
    return rows.select(F.col("conv_id").alias("doc_id"), chapter.alias("chapter"), F.concat(F.lit("Chapter "), chapter).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def segments(rows: DataFrame, size: int = SEGMENT, overlap: int = OVERLAP) -> DataFrame:
    """rows(doc_id, text) -> doc_id, idx, start_token, end_token, text: overlapping runs of words; none for an empty text."""
    if size <= 0:
        return rows.select("doc_id", F.lit(0).alias("idx"), F.lit(0).alias("start_token"), F.lit(0).alias("end_token"), "text").where("false")
    step = size - min(max(overlap, 0), size - 1)
    words = rows.select("doc_id", T.fields(F.col("text")).alias("words")).where("size(words) > 0")
    cut = words.select("doc_id", "words", F.posexplode_outer(T.starts(F.size("words"), size, step)).alias("idx", "start_token"))
    end = F.least(F.col("start_token") + size, F.size("words"))
    return cut.select("doc_id", "idx", "start_token", end.alias("end_token"), F.array_join(F.slice("words", F.col("start_token") + 1, F.lit(size)), " ").alias("text"))


def windows(rows: DataFrame, size: int = 900, stride: int = 450) -> DataFrame:
    """rows(doc_id, words) -> doc_id, w, start_word, end_word, words, n_windows; a document without words has one empty window."""
    size = size if size > 0 else 900
    stride = stride if stride > 0 else size // 2
    begun = rows.select("doc_id", F.col("words").alias("all"), T.starts(F.size("words"), size, stride).alias("begins"))
    cut = begun.select("doc_id", "all", F.size("begins").alias("n_windows"), F.posexplode_outer("begins").alias("w", "start_word"))
    return cut.select("doc_id", "w", "start_word", F.least(F.col("start_word") + size, F.size("all")).alias("end_word"), F.slice("all", F.col("start_word") + 1, F.lit(size)).alias("words"), "n_windows")


def is_header(line: Column) -> Column:
    return line.rlike(LINE)


def chapters(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text) -> doc_id, chapter, title, text; rows with chapter_list() in `chapters` have them already."""
    made = rows if "chapters" in rows.columns else rows.select("doc_id", chapter_list(F.col("text")).alias("chapters"))
    return made.select("doc_id", F.posexplode_outer("chapters").alias("chapter", "c")).select("doc_id", (F.col("chapter") + 1).alias("chapter"), "c.title", "c.text")


def chapter_list(text: Column) -> Column:
    """array<struct<title, text>> of a text's chapters.

    Three ways, in this order: at headers anywhere in the text if there are three or more; else at header lines, with what
    stands before the first as a chapter; else runs of 2,500 words. All are array expressions on the row.
    """
    text = F.replace(text, F.lit(MARK), F.lit(""))

    def titled(piece: Column, i: Column) -> Column:
        head = T.first_words(piece, 8)
        return F.struct(F.when(is_header(head), head).otherwise(F.concat(F.lit("Chapter "), i + 1)).alias("title"), piece.alias("text"))

    pieces = F.split(F.regexp_replace(text, INLINE, MARK + "$0"), MARK)
    numbered = F.transform(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), T.trimmed), titled)
    lines = F.filter(F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), T.trimmed), lambda x: x != "")
    # a header opens a block; a block without lines vanishes, and its title with it
    marked = F.array_join(F.transform(lines, lambda x: F.when(is_header(x), F.concat(F.lit(MARK), x)).otherwise(x)), "\n")
    blocks = F.transform(F.split(marked, MARK), lambda b, i: F.struct(F.when(i > 0, F.regexp_extract(b, r"^([^\n]*)", 1)).otherwise(F.lit("")).alias("title"), F.when(i > 0, F.regexp_replace(b, r"^[^\n]*\n?", "")).otherwise(b).alias("text")))
    blocks = F.filter(F.transform(blocks, lambda b: F.struct(b["title"].alias("title"), F.regexp_replace(b["text"], r"\n\z", "").alias("text"))), lambda b: b["text"] != "")
    by_line = F.transform(blocks, lambda b, i: F.struct(F.when(b["title"] == "", F.concat(F.lit("Chapter "), i + 1)).otherwise(b["title"]).alias("title"), b["text"].alias("text")))
    words = T.fields(text)
    chunked = F.transform(T.starts(F.size(words), CHUNK, CHUNK), lambda s, i: F.struct(F.concat(F.lit("Chapter "), i + 1).alias("title"), F.array_join(F.slice(words, s + 1, F.lit(CHUNK)), " ").alias("text")))
    # headers are counted first, and only the way that is taken is built; a text without blocks by lines has none but white space
    by_lines = T.let(by_line, lambda found: F.when(F.size(found) > 0, found).otherwise(chunked))
    return F.when(F.regexp_count(text, F.lit(INLINE)) >= 3, numbered).otherwise(by_lines)


def segment_count(n: Column, size: int = SEGMENT, overlap: int = OVERLAP) -> Column:
    """How many rows segments() has for n words; null for none."""
    return F.when(n > 0, F.size(T.starts(n, size, size - min(max(overlap, 0), size - 1))))


def genre_sample(t: Column) -> Column:
    """Up to 900 words whole; else 300 words of the start, the middle and the end."""
    words = T.fields(t)
    n = F.size(words)
    join = lambda a: F.array_join(a, " ")
    parts = F.concat(F.lit("[START]\n"), join(F.slice(words, 1, 300)), F.lit("\n[MIDDLE]\n"), join(F.slice(words, F.floor(n / 2).cast("int") - 149, F.lit(300))), F.lit("\n[END]\n"), join(F.slice(words, F.greatest(n - 299, F.lit(1)), F.lit(300))))
    return F.when(n <= 900, join(words)).otherwise(parts)


def safety_sample(chaps: DataFrame) -> DataFrame:
    """chapters -> doc_id, sample: 180 words of each of the first twelve chapters."""
    first = chaps.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter"))).where("rank <= 12")
    line = F.concat(F.lit("[Ch "), F.col("chapter"), F.lit(" "), F.col("title"), F.lit("] "), T.first_words(F.col("text"), 180))
    return first.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chapter", line.alias("line")))).alias("lines")).select("doc_id", F.array_join("lines.line", "\n").alias("sample"))


def misspelled(word: Column) -> Column:
    return (F.octet_length(word) > 2) & (~word.rlike(VOWEL) | word.rlike(CLUSTER))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.size(T.prose_words(t)).alias("n_prose"), F.size(T.detector_words(T.normal_text(t))).alias("n_detector"), F.size(T.fields(t)).alias("n_fields"), T.count_all(t, "[A-Za-z0-9']+").alias("n_alnum"))


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(T.lines_tidied(t)).alias("tidied"), F.md5(T.normal_text(t)).alias("normal"), F.md5(T.normal_block(t)).alias("block"))


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    split = rows.select("doc_id", F.lit("split").alias("kind"), F.posexplode_outer(T.split_sentences(F.col("text"))).alias("pos", "sentence")).where("pos IS NOT NULL")
    kept = rows.select("doc_id", F.lit("kept").alias("kind"), F.posexplode_outer(T.kept_sentences(F.col("text"))).alias("pos", "sentence")).where("pos IS NOT NULL")
    return split.unionByName(kept)


def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(docs(spark, sf_dir)).withColumn("text", F.md5("text"))


def text_segments_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(docs(spark, sf_dir), 100, 20).withColumn("text", F.md5("text"))


def detector_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", T.detector_words(T.normal_text(F.col("text"))).alias("words"))
    return windows(rows).drop("n_windows").withColumn("words", F.md5(F.array_join("words", " ")))


def headed(rows: DataFrame) -> DataFrame:
    """Documents with headers put in, so that each way of splitting has some: by doc_id modulo 4."""
    way, t, id_ = F.col("doc_id") % 4, F.col("text"), F.col("doc_id").cast("string")
    made = (
        F.when(way == 0, F.concat(F.lit("Intro words\nChapter 1\n"), t, F.lit("\nCh. two: onward\n"), t, F.lit("\nCHAPTER III the end "), t))
        .when(way == 1, F.concat(F.lit("Before it\n  Chapter "), id_, F.lit(" Dawn\nfirst line\n\n"), T.first_words(t, 30), F.lit("\nchapter 9\n")))
        .when(way == 2, F.concat(F.lit("Chapter "), id_))
        .otherwise(t)
    )
    return rows.select("doc_id", made.alias("text"))


def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters(headed(docs(spark, sf_dir))).select("doc_id", "chapter", "title", F.md5("text").alias("text"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(genre_sample(F.col("text"))).alias("sample"))


def safety_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety_sample(turns(spark, sf_dir)).withColumn("sample", F.md5("sample"))


def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.prose_words(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(F.filter(words, misspelled)).alias("misspelled"))


def heading_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headed(docs(spark, sf_dir)).select("doc_id", T.count_all(F.col("text"), rf"(?imd)^[\t\n\f\r ]*(chapter|ch\.?)[\t\n\f\r ]+([0-9ivxlcdm]+){T.EDGE}").alias("headings"))


# --- DuckDB ---------------------------------------------------------------------------------------------------------------

_D = "(SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents)"
W = T.WIDE
B = r"[\t\n\f\r ]"


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{W}+|{W}+\z', '', 'g')"


def sql_fields(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{W}+'), lambda x: x <> '')"


def sql_first(x: str, n: int) -> str:
    return f"array_to_string({sql_fields(x)}[1:{n}], ' ')"


def sql_prose(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z'']+')"


def sql_normal(x: str) -> str:
    y = rf"regexp_replace(lower(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))), '[^a-z0-9\t\n\f\r .?!]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({y}, '^{B}+|{B}+\z', '', 'g'), '[ \t]+', ' ', 'g')"


def sql_block(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\t\n\f\r ]+', ' ', 'g'), '^{B}+|{B}+\z', '', 'g'), '{B}+', ' ', 'g')"


def sql_detector(x: str) -> str:
    return f"regexp_extract_all({sql_normal(x)}, '[a-z0-9'']+')"


def sql_md5_lines(x: str) -> str:
    return f"md5(array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda y: array_to_string({sql_fields('y')}, ' ')), lambda y: y <> ''), chr(10)))"


def sql_segments(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""WITH w AS (SELECT doc_id, {sql_fields('text')} AS ws FROM {_D}), s AS (SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) <= {size} THEN 1 ELSE 1 + ceil((len(ws) - {size}) / {step}.0)::BIGINT END)) AS i FROM w WHERE len(ws) > 0)
SELECT doc_id, i::INT AS idx, (i * {step})::INT AS start_token, least(i * {step} + {size}, len(ws))::INT AS end_token, md5(array_to_string(ws[i * {step} + 1:i * {step} + {size}], ' ')) AS text FROM s"""


HEADED = f"""(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Intro words' || chr(10) || 'Chapter 1' || chr(10) || text || chr(10) || 'Ch. two: onward' || chr(10) || text || chr(10) || 'CHAPTER III the end ' || text
 WHEN 1 THEN 'Before it' || chr(10) || '  Chapter ' || doc_id || ' Dawn' || chr(10) || 'first line' || chr(10) || chr(10) || {sql_first('text', 30)} || chr(10) || 'chapter 9' || chr(10)
 WHEN 2 THEN 'Chapter ' || doc_id ELSE text END AS text FROM {_D})"""
SQL_INLINE = rf"(?i)\b(chapter|ch\.)\s+([0-9ivxlcdm]+|{NUMBERS})\b"
SQL_LINE = rf"(?i)^\s*(chapter|ch\.)\s+([0-9ivxlcdm]+|{NUMBERS})\b.*"
CHAPTERS = f"""
WITH d AS (SELECT * FROM {HEADED}),
p AS (SELECT doc_id, text, string_split(regexp_replace(text, '{SQL_INLINE}', chr(1) || '\\0', 'g'), chr(1)) AS ps FROM d),
a AS (SELECT doc_id, i::INT AS chapter, {sql_trim('ps[i + 1]')} AS t FROM (SELECT doc_id, ps, unnest(range(1, len(ps))) AS i FROM p WHERE len(ps) >= 4)),
l AS (SELECT doc_id, i, {sql_trim('ls[i]')} AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM p WHERE len(ps) < 4))),
g AS (SELECT *, regexp_matches(line, '{SQL_LINE}') AS head, sum(regexp_matches(line, '{SQL_LINE}')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM l WHERE line <> ''),
k AS (SELECT doc_id, grp, coalesce(max(line) FILTER (head), '') AS title, string_agg(line, chr(10) ORDER BY i) FILTER (NOT head) AS t FROM g GROUP BY doc_id, grp),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp)::INT AS chapter, title, t FROM k WHERE t IS NOT NULL),
w AS (SELECT doc_id, {sql_fields('text')} AS ws FROM p WHERE len(ps) < 4 AND doc_id NOT IN (SELECT doc_id FROM b)),
c AS (SELECT doc_id, (i + 1)::INT AS chapter, array_to_string(ws[i * 2500 + 1:i * 2500 + 2500], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(0, greatest(1, ceil(len(ws) / 2500.0)::BIGINT))) AS i FROM w))
SELECT doc_id, chapter, CASE WHEN regexp_matches({sql_first('t', 8)}, '{SQL_LINE}') THEN {sql_first('t', 8)} ELSE 'Chapter ' || chapter END AS title, md5(t) AS text FROM a
UNION ALL SELECT doc_id, chapter, CASE WHEN title = '' THEN 'Chapter ' || chapter ELSE title END, md5(t) FROM b
UNION ALL SELECT doc_id, chapter, 'Chapter ' || chapter, md5(t) FROM c"""
SENTENCE_SPLIT = f"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {sql_trim('s')}), lambda s: s <> '')"
SENTENCE_KEPT = f"list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda s: {sql_trim('s')}), lambda s: s <> '')"
TURNS = "(SELECT conv_id AS doc_id, (turn + 1)::INT AS chapter, 'Chapter ' || (turn + 1) AS title, coalesce(text, '') AS text FROM conversations)"

QUERIES = {
    "word_counts": word_counts, "normal_forms": normal_forms, "sentence_rows": sentence_rows, "text_segments": text_segments, "text_segments_small": text_segments_small,
    "detector_windows": detector_windows, "chapter_split": chapter_split, "genre_samples": samples, "safety_samples": safety_samples, "spelling": spelling, "heading_estimate": heading_estimate,
}
ORACLES = {
    "word_counts": f"SELECT doc_id, len({sql_prose('text')})::INT AS n_prose, len({sql_detector('text')})::INT AS n_detector, len({sql_fields('text')})::INT AS n_fields, len(regexp_extract_all(text, '[A-Za-z0-9'']+'))::INT AS n_alnum FROM {_D}",
    "normal_forms": f"SELECT doc_id, {sql_md5_lines('text')} AS tidied, md5({sql_normal('text')}) AS normal, md5({sql_block('text')}) AS block FROM {_D}",
    "sentence_rows": f"WITH s AS (SELECT doc_id, {SENTENCE_SPLIT} AS a, {SENTENCE_KEPT} AS b FROM {_D}) SELECT doc_id, 'split' AS kind, (i - 1)::INT AS pos, a[i] AS sentence FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM s) UNION ALL SELECT doc_id, 'kept', (i - 1)::INT, b[i] FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM s)",
    "text_segments": sql_segments(1500, 200),
    "text_segments_small": sql_segments(100, 20),
    "detector_windows": f"WITH w AS (SELECT doc_id, {sql_detector('text')} AS ws FROM {_D}), s AS (SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) <= 900 THEN 1 ELSE 1 + ceil((len(ws) - 900) / 450.0)::BIGINT END)) AS i FROM w) SELECT doc_id, i::INT AS w, (i * 450)::INT AS start_word, least(i * 450 + 900, len(ws))::INT AS end_word, md5(array_to_string(ws[i * 450 + 1:i * 450 + 900], ' ')) AS words FROM s",
    "chapter_split": CHAPTERS,
    "genre_samples": f"WITH w AS (SELECT doc_id, {sql_fields('text')} AS ws FROM {_D}) SELECT doc_id, md5(CASE WHEN len(ws) <= 900 THEN array_to_string(ws, ' ') ELSE '[START]' || chr(10) || array_to_string(ws[1:300], ' ') || chr(10) || '[MIDDLE]' || chr(10) || array_to_string(ws[len(ws) // 2 - 149:len(ws) // 2 + 150], ' ') || chr(10) || '[END]' || chr(10) || array_to_string(ws[len(ws) - 299:len(ws)], ' ') END) AS sample FROM w",
    "safety_samples": f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chapter) AS k FROM {TURNS}) SELECT doc_id, md5(string_agg('[Ch ' || chapter || ' ' || title || '] ' || {sql_first('text', 180)}, chr(10) ORDER BY chapter)) AS sample FROM r WHERE k <= 12 GROUP BY doc_id",
    "spelling": f"SELECT doc_id, len(list_filter({sql_prose('text')}, lambda w: strlen(w) > 2 AND (NOT regexp_matches(w, '{VOWEL}') OR regexp_matches(w, '{CLUSTER}'))))::INT AS misspelled FROM {_D}",
    "heading_estimate": rf"SELECT doc_id, len(regexp_extract_all(text, '(?im)^\s*(chapter|ch\.?)\s+([0-9ivxlcdm]+)\b'))::INT AS headings FROM {HEADED}",
}
