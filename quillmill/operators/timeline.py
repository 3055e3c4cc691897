"""Time markers, events around them, and a manuscript's timeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scan import scanned
from .characters import _EVENTS, MARKERS, STORIED, chapter_summaries, storied, whole
from .text import _D, docs, sql_first

PATTERN = "(?i)" + whole(MARKERS)
BEFORE, AFTER, EVENTS, TIMELINE, FALLBACK = 80, 120, 15, 40, 12


def markers(t: Column) -> Column:
    return T.find_all(t, PATTERN)


def events_around(rows: DataFrame, most: int = EVENTS) -> DataFrame:
    """rows(doc_id, text) -> doc_id, ord, time_marker, event: each marker with 80 bytes before and 120 after it, in UTF-8; a character that a cut would split is left out.

    Two passes over the pieces between markers carry what stands before and behind each one, never more than a cut takes, so many
    markers cost no more than their text.
    """
    most = most if most > 0 else EVENTS
    # a cut of n bytes lies within n characters, so what is carried is counted in these
    pieces = rows.withColumn("_gaps", F.split("text", PATTERN, most + 1)).withColumn("_found", F.slice(markers(F.col("text")), 1, most))
    pieces = pieces.withColumn("_tail", F.element_at("_gaps", -1)).withColumn("_items", F.arrays_zip(F.slice(F.col("_gaps"), F.lit(1), F.size("_found")).alias("gap"), F.col("_found").alias("marker")))
    before = scanned("_items", "''", "string", f"right(concat(s, x.gap), {BEFORE})", f"right(concat(right(concat(s, x.gap), {BEFORE}), x.marker), {BEFORE})")
    behind = scanned("reverse(_items)", f"left(_tail, {AFTER})", "string", "s", f"left(concat(left(concat(left(x.gap, {AFTER}), x.marker), {AFTER}), s), {AFTER})")
    told = pieces.withColumn("_before", F.expr(before)).withColumn("_behind", F.reverse(F.expr(behind)))
    cut = told.select("doc_id", F.posexplode_outer(F.arrays_zip(F.col("_found").alias("marker"), F.col("_before").alias("before"), F.col("_behind").alias("behind"))).alias("ord", "x")).where("x IS NOT NULL")
    fragment = F.concat(_bytes(F.col("x.before"), BEFORE, F.right), F.col("x.marker"), _bytes(F.col("x.behind"), AFTER, F.left))
    return cut.select("doc_id", "ord", F.col("x.marker").alias("time_marker"), F.regexp_replace(fragment, f"{T.BLANK}+", " ").alias("event"))


def _bytes(t: Column, n: int, side: Callable[[Column, Column], Column]) -> Column:
    """As many whole characters of one end of t as n bytes hold."""
    sizes = F.filter(F.sequence(F.lit(0), F.least(F.length(t), F.lit(n))), lambda k: F.octet_length(side(t, k)) <= n)
    return F.when(F.octet_length(t) <= n, t).otherwise(side(t, F.array_max(sizes)))


def timeline(chaps: DataFrame, summaries: DataFrame) -> DataFrame:
    """doc_id, ord, time_marker, event: up to 40 markers in chapter order; a manuscript without any has up to 12 chapter rows."""
    found, head = ("markers", "head") if "markers" in chaps.columns else (markers(F.col("text")), F.col("text"))
    head = T.first_words(F.col(head) if isinstance(head, str) else head, 16)  # all of the text that a row without markers may show
    label = F.concat(F.lit("Ch "), F.col("chapter"), F.lit(" "), F.col("title"), F.lit(": "), head)
    rows = chaps.select("doc_id", "chapter", label.alias("event"), F.posexplode_outer(found).alias("pos", "time_marker")).where("time_marker IS NOT NULL")
    w = Window.partitionBy("doc_id").orderBy("chapter", "pos")
    marked = rows.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= TIMELINE).select("doc_id", "ord", "time_marker", "event")
    heads = chaps.select("doc_id", "chapter", head.alias("head"))
    rest = heads.join(marked.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter"))).where(F.col("ord") <= FALLBACK)
    rest = rest.join(summaries.select("doc_id", "chapter", "events", "summary"), ["doc_id", "chapter"], "left")
    told = F.when(F.size("events") > 0, F.col("events")[0]).when(F.col("summary") != "", T.first_words(F.col("summary"), 16)).otherwise(F.col("head"))
    return marked.unionByName(rest.select("doc_id", "ord", F.concat(F.lit("Chapter "), F.col("chapter")).alias("time_marker"), told.alias("event")))


def time_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.array_join(markers(F.col("text")), "|").alias("markers"))


def marker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = storied(spark, sf_dir).select(F.concat_ws("-", "doc_id", "chapter").alias("doc_id"), F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))
    return events_around(rows)


WIDER = (("a", "á"), ("o", "中"), ("t", "𝒕"))  # characters of two, three and four bytes in place of one


def marker_events_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of them in texts with characters of several bytes."""
    wide = F.col("text")
    for plain, other in WIDER:
        wide = F.replace(wide, F.lit(f"{plain} "), F.lit(f"{other} "))
    rows = storied(spark, sf_dir).select(F.concat_ws("-", "doc_id", "chapter").alias("doc_id"), wide.alias("text"))
    return events_around(rows, 1000)


def manuscript_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    chaps = storied(spark, sf_dir)
    return timeline(chaps, chapter_summaries(chaps))


_WIDE = "replace(replace(replace(text, 'a ', 'á '), 'o ', '中 '), 't ', '𝒕 ')"
_SQLM = rf"(?i)\b({MARKERS})\b"
QUERIES = {"time_markers": time_markers, "marker_events": marker_events, "marker_events_bytes": marker_events_bytes, "manuscript_timeline": manuscript_timeline}
ORACLES = {
    "time_markers": f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{_SQLM}'), '|') AS markers FROM {_D}",
    "marker_events": rf"""WITH t AS (SELECT doc_id || '-' || chapter AS doc_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM {STORIED}), m AS (SELECT *, regexp_split_to_array(text, '{_SQLM}') AS gaps, regexp_extract_all(text, '{_SQLM}') AS ms FROM t),
e AS (SELECT doc_id, text, i, ms[i] AS marker, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::INT AS s FROM (SELECT *, unnest(range(1, least(15, len(ms)) + 1)) AS i FROM m))
SELECT doc_id, (i - 1)::INT AS ord, marker AS time_marker, regexp_replace(substr(text, greatest(0, s - 80) + 1, least(length(text), s + length(marker) + 120) - greatest(0, s - 80)), '\s+', ' ', 'g') AS event FROM e""",
    "marker_events_bytes": rf"""WITH t AS (SELECT doc_id || '-' || chapter AS doc_id, {_WIDE} AS text FROM {STORIED}), m AS (SELECT *, regexp_split_to_array(text, '{_SQLM}') AS gaps, regexp_extract_all(text, '{_SQLM}') AS ms FROM t),
e AS (SELECT doc_id, text, i, ms[i] AS marker, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::INT AS s FROM (SELECT *, unnest(range(1, least(1000, len(ms)) + 1)) AS i FROM m)),
c AS (SELECT *, substr(text, greatest(0, s - 80) + 1, least(s, 80)) AS pre, substr(text, s + length(marker) + 1, 120) AS post FROM e)
SELECT doc_id, (i - 1)::INT AS ord, marker AS time_marker, regexp_replace(right(pre, list_max(list_filter(range(0, 81), lambda k: strlen(right(pre, k)) <= 80))) || marker || left(post, list_max(list_filter(range(0, 121), lambda k: strlen(left(post, k)) <= 120))), '\s+', ' ', 'g') AS event FROM c""",
    "manuscript_timeline": f"""WITH {_EVENTS}, c AS (SELECT * FROM ev), x AS (SELECT *, regexp_extract_all(text, '{_SQLM}') AS ms FROM c),
mk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chapter, i) AS ord, ms[i] AS time_marker, 'Ch ' || chapter || ' ' || title || ': ' || {sql_first('text', 16)} AS event FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM x)),
rs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chapter) AS ord FROM c WHERE doc_id NOT IN (SELECT doc_id FROM mk))
SELECT doc_id, ord::INT AS ord, time_marker, event FROM mk WHERE ord <= 40 UNION ALL SELECT doc_id, ord::INT, 'Chapter ' || chapter, events[1] FROM rs WHERE ord <= 12""",
}
