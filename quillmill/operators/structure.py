"""Chapter metrics, beats in chapter ranges, and plot-structure probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .characters import _EVENTS, STORIED, chapter_summaries, storied
from .genre import FREQUENT, KEYWORDS, TOP, _sql_scores, normalised, scores
from .text import sql_fields, sql_first
from .timeline import _SQLM, markers, timeline

# Fixed values.
BEATS = (("Catalyst", 0.10, 0.12), ("Midpoint", 0.45, 0.55), ("All is Lost", 0.75, 0.76))
STRUCTURES = {"Save the Cat": 0.55, "Three Act": 0.30, "Fichtean Curve": 0.10, "Hero's Journey": 0.05}
LEAST = 0.001
HEAD_WORDS = 22
NO_TEXT = "Insufficient chapter text in beat window."
FALLBACK = "Heuristic fallback from chapter-position windows."


def chapters_in(n: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """First and last chapter (from 1) of a share of n chapters; 0 and 0 for none."""
    end = F.least(n, F.floor(n * high).cast("int") + 1)
    start = F.least(F.greatest(F.lit(1), F.floor(n * low).cast("int") + 1), end)
    return F.when(n > 0, start).otherwise(0), F.when(n > 0, end).otherwise(0)


def chapter_metrics(chaps: DataFrame, keywords=KEYWORDS) -> DataFrame:
    """chapters -> doc_id, chapter, title, n_words, n_markers, top_genre, top_score, breakdown (best four)."""
    rows = scores(chaps, keywords)
    if "n_words" not in rows.columns:
        rows = rows.select("*", F.size(T.fields(F.col("text"))).alias("n_words"), markers(F.col("text")).alias("markers"))
    return rows.select("doc_id", "chapter", "title", "n_words", F.size("markers").alias("n_markers"), F.col("genres")[0]["name"].alias("top_genre"), F.col("genres")[0]["score"].alias("top_score"), F.slice("genres", 1, TOP).alias("breakdown"))


def beat_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, n) -> doc_id, beat, name, start_chapter, end_chapter; three rows a document with chapters."""
    beats = F.array(*[F.struct(F.lit(i).alias("beat"), F.lit(n).alias("name"), F.lit(a).alias("low"), F.lit(b).alias("high")) for i, (n, a, b) in enumerate(BEATS)])
    rows = docs.where("n > 0").select("doc_id", "n", F.explode_outer(beats).alias("b"))
    start, end = chapters_in(F.col("n"), F.col("b.low"), F.col("b.high"))
    return rows.select("doc_id", "b.beat", "b.name", start.alias("start_chapter"), end.alias("end_chapter"))


def beats(chaps: DataFrame, summaries: DataFrame, metrics: DataFrame, line: DataFrame) -> DataFrame:
    """doc_id, beat, name, start_chapter, end_chapter, is_beat, reasoning: the first and last snippet of each range."""
    ranges = beat_ranges(chaps.groupBy("doc_id").agg(F.count("*").cast("int").alias("n")))
    known = chaps.select("doc_id", "chapter", T.first_words(F.col("head" if "head" in chaps.columns else "text"), HEAD_WORDS).alias("head")).join(summaries.select("doc_id", "chapter", "events", "summary"), ["doc_id", "chapter"], "left")
    snippet = F.when(F.size("events") > 0, T.first_words(F.col("events")[0], 22)).when(F.col("summary") != "", T.first_words(F.col("summary"), 22)).otherwise(F.col("head"))
    c = known.select(F.col("doc_id").alias("d"), "chapter", snippet.alias("snippet"))
    inside = ranges.join(c, (F.col("doc_id") == F.col("d")) & F.col("chapter").between(F.col("start_chapter"), F.col("end_chapter")), "left")
    ends = inside.groupBy("doc_id", "beat", "name", "start_chapter", "end_chapter").agg(F.count("snippet").alias("n"), F.min_by("snippet", "chapter").alias("first"), F.max_by("snippet", "chapter").alias("last"))
    ends = ends.join(metrics.select("doc_id", F.col("chapter").alias("start_chapter"), "top_genre", "n_markers"), ["doc_id", "start_chapter"], "left").join(line.groupBy("doc_id").agg(F.count("*").alias("n_events")), "doc_id", "left")
    note = F.when(F.col("top_genre").isNotNull(), F.format_string(" (start genre=%s, timeline_markers=%d)", "top_genre", "n_markers")).otherwise("")
    told = F.when(F.col("n") == 0, F.lit(NO_TEXT)).otherwise(F.concat("first", F.when(F.col("n") > 1, F.concat(F.lit(" ... "), "last")).otherwise(""), note))
    counted = F.when(F.col("n_events") > 0, F.format_string(" [timeline_events=%d]", "n_events")).otherwise("")
    return ends.select("doc_id", "beat", "name", "start_chapter", "end_chapter", (F.col("n") > 0).alias("is_beat"), F.concat(told, counted).alias("reasoning"))


def structure_probabilities(given: Column | None = None) -> Column:
    """array<struct<name, score>>, best first: a provider's positive scores by name (any case), a floor for the rest; without a provider the fixed ones."""
    if given is None:
        return normalised([F.lit(v) for v in STRUCTURES.values()], tuple(STRUCTURES))
    lowered = F.transform_keys(given, lambda k, v: F.lower(k))
    value = lambda n: F.coalesce(F.try_element_at(lowered, F.lit(n.lower())), F.lit(0.0))
    return normalised([F.when(value(n) > 0, value(n)).otherwise(F.lit(LEAST)) for n in STRUCTURES], tuple(STRUCTURES))


ANSWER = "selected_structure string, reasoning string, structure_probabilities map<string,double>, beats array<struct<name:string,start_chapter:int,end_chapter:int,is_beat:boolean,reasoning:string>>"


def decided(chaps: DataFrame, answers: DataFrame | None = None, provider: str = "provider") -> DataFrame:
    """doc_id, provider, selected, probabilities, reasoning: a model's view of each manuscript with chapters, or the fixed one.

    answers(doc_id, answer, error): answer is a JSON object as in ANSWER; a failed one leaves its error in the reason.
    """
    rows = chaps.select("doc_id").distinct()
    fixed = structure_probabilities()
    if answers is None:
        return rows.select("doc_id", F.lit("heuristic").alias("provider"), F.lit(next(iter(STRUCTURES))).alias("selected"), fixed.alias("probabilities"), F.lit(FALLBACK).alias("reasoning"))
    told = answers.select("doc_id", F.from_json("answer", ANSWER).alias("a"), F.col("answer").isNotNull().alias("given"), "error")
    rows = rows.join(told, "doc_id", "left").withColumn("given", F.coalesce("given", F.lit(False)))
    theirs = structure_probabilities(F.coalesce("a.structure_probabilities", F.create_map().cast("map<string,double>")))
    filled_in = lambda c, default: F.when(F.coalesce(T.trimmed(F.col(c)), F.lit("")) != "", T.trimmed(F.col(c))).otherwise(default)
    rows = rows.withColumn("probabilities", F.when(F.col("given"), theirs).otherwise(fixed))
    failed = F.concat(F.lit(FALLBACK), F.when(F.col("error").isNotNull(), F.concat(F.lit(" Provider unavailable: "), "error")).otherwise(""))
    selected = F.when(F.col("given"), filled_in("a.selected_structure", F.col("probabilities")[0]["name"])).otherwise(next(iter(STRUCTURES)))
    why = F.when(F.col("given"), filled_in("a.reasoning", F.lit("The model chose the structure by what happens in each chapter."))).otherwise(failed)
    return rows.select("doc_id", F.when(F.col("given"), provider).otherwise("heuristic").alias("provider"), selected.alias("selected"), "probabilities", why.alias("reasoning"))


def overlaid(own: DataFrame, answers: DataFrame, chaps: DataFrame) -> DataFrame:
    """Beats, with a model's in place of a manuscript's own where it named any."""
    told = answers.select("doc_id", F.posexplode(F.from_json("answer", ANSWER)["beats"]).alias("beat", "b")).select("doc_id", "beat", "b.*")
    given = provider_beats(told.withColumn("is_beat", F.coalesce("is_beat", F.lit(False))), chaps)
    return own.join(given.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(given)


def provider_beats(given: DataFrame, chaps: DataFrame) -> DataFrame:
    """A provider's beats(doc_id, beat, name, start_chapter, end_chapter, is_beat, reasoning), held to the chapters there are."""
    rows = given.join(chaps.groupBy("doc_id").agg(F.count("*").cast("int").alias("n")), "doc_id")
    first = F.least(F.when(F.col("start_chapter") > 0, F.col("start_chapter")).otherwise(1), F.col("n"))
    last = F.least(F.when(F.col("end_chapter") > 0, F.col("end_chapter")).otherwise(first), F.col("n"))
    rows = rows.withColumn("start_chapter", F.least(first, last)).withColumn("end_chapter", last)
    rows = rows.join(chaps.select("doc_id", F.col("chapter").alias("start_chapter"), T.first_words(F.col("text"), 18).alias("opening")), ["doc_id", "start_chapter"], "left")
    given_or = lambda c, default: F.when(F.coalesce(T.trimmed(F.col(c)), F.lit("")) == "", default).otherwise(T.trimmed(F.col(c)))
    return rows.select("doc_id", "beat", given_or("name", F.lit("Beat")).alias("name"), "start_chapter", "end_chapter", "is_beat", given_or("reasoning", F.col("opening")).alias("reasoning"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chapter_metrics(storied(spark, sf_dir), FREQUENT)
    return rows.withColumn("top_score", F.round("top_score", 6)).withColumn("breakdown", F.array_join(F.transform("breakdown", lambda g: g["name"]), ","))


def beat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beat_ranges(spark.range(0, 101).select(F.col("id").alias("doc_id"), F.col("id").cast("int").alias("n")))


def manuscript_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chaps = storied(spark, sf_dir)
    found = chapter_summaries(chaps)
    return beats(chaps, found.where("chapter % 4 <> 0"), chapter_metrics(chaps, FREQUENT), timeline(chaps, found))


def plot_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores given by a document's quality label stand in for a provider's."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    given = F.create_map(F.lit("three act"), (F.col("quality") + F.col("doc_id") % 3).cast("double"), F.lit("Unknown"), F.lit(4.0), F.lit("HERO'S JOURNEY"), (F.col("doc_id") % 5 - 1).cast("double"))
    rows = labels.select("doc_id", structure_probabilities(given).alias("genres"))
    return rows.select("doc_id", F.posexplode_outer("genres").alias("rank", "x")).select("doc_id", (F.col("rank") + 1).alias("rank"), F.col("x.name").alias("name"), F.round("x.score", 6).alias("probability"))


_RANGE = "CASE WHEN n > 0 THEN least(greatest(1, floor(n * lo)::INT + 1), least(n, floor(n * hi)::INT + 1)) END AS start_chapter, least(n, floor(n * hi)::INT + 1)::INT AS end_chapter"
_BEATS = "(VALUES (0, 'Catalyst', 0.10::DOUBLE, 0.12::DOUBLE), (1, 'Midpoint', 0.45::DOUBLE, 0.55::DOUBLE), (2, 'All is Lost', 0.75::DOUBLE, 0.76::DOUBLE)) b(beat, name, lo, hi)"
_GENRES = _sql_scores(STORIED, FREQUENT, "doc_id, chapter")
_structs = ", ".join(f"({i}, '{n.replace(chr(39), chr(39) * 2)}')" for i, n in enumerate(STRUCTURES))
QUERIES = {"chapter_metrics": metrics, "beat_ranges": beat_table, "manuscript_beats": manuscript_beats, "plot_structure": plot_structure}
ORACLES = {
    "chapter_metrics": f"WITH g AS ({_GENRES}), t AS (SELECT doc_id, chapter, arg_min(genre, rank) AS top_genre, round(max(score), 6) AS top_score, string_agg(genre, ',' ORDER BY rank) FILTER (rank <= 4) AS breakdown FROM g GROUP BY doc_id, chapter) SELECT s.doc_id, s.chapter, s.title, len({sql_fields('text')})::INT AS n_words, len(regexp_extract_all(text, '{_SQLM}'))::INT AS n_markers, top_genre, top_score, breakdown FROM {STORIED} s JOIN t USING (doc_id, chapter)",
    "beat_ranges": f"SELECT n::BIGINT AS doc_id, beat, name, {_RANGE} FROM (SELECT unnest(range(1, 101))::INT AS n), {_BEATS}",
    "manuscript_beats": f"""WITH {_EVENTS}, g AS ({_GENRES}), cn AS (SELECT doc_id, count(*)::INT AS n, sum(len(regexp_extract_all(text, '{_SQLM}'))) AS marks FROM ev GROUP BY doc_id),
br AS (SELECT doc_id, marks, n, beat, name, {_RANGE} FROM cn, {_BEATS}), c AS (SELECT doc_id, chapter, text, CASE WHEN chapter % 4 <> 0 THEN {sql_first('events[1]', 22)} ELSE {sql_first('text', 22)} END AS s FROM ev),
be AS (SELECT r.doc_id, beat, name, start_chapter, end_chapter, any_value(CASE WHEN marks > 0 THEN least(40, marks) ELSE least(12, n) END) AS ne, count(s) AS k, arg_min(s, chapter) AS a, arg_max(s, chapter) AS z FROM br r LEFT JOIN c ON c.doc_id = r.doc_id AND chapter BETWEEN start_chapter AND end_chapter GROUP BY r.doc_id, beat, name, start_chapter, end_chapter)
SELECT e.doc_id, beat, name, start_chapter, end_chapter, k > 0 AS is_beat, a || CASE WHEN k > 1 THEN ' ... ' || z ELSE '' END || ' (start genre=' || genre || ', timeline_markers=' || len(regexp_extract_all(text, '{_SQLM}')) || ')' || CASE WHEN ne > 0 THEN ' [timeline_events=' || ne || ']' ELSE '' END AS reasoning FROM be e JOIN g ON g.doc_id = e.doc_id AND g.chapter = start_chapter AND rank = 1 JOIN ev ON ev.doc_id = e.doc_id AND ev.chapter = start_chapter""",
    "plot_structure": f"WITH v AS (SELECT doc_id, place, name, CASE WHEN place = 1 AND quality + doc_id % 3 > 0 THEN (quality + doc_id % 3)::DOUBLE WHEN place = 3 AND doc_id % 5 - 1 > 0 THEN (doc_id % 5 - 1)::DOUBLE ELSE 0.001::DOUBLE END AS v FROM labels, (VALUES {_structs}) s(place, name)), p AS (SELECT doc_id, place, name, v / sum(v) OVER (PARTITION BY doc_id) AS p, v FROM v) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, place)::INT AS rank, name, round(p, 6) AS probability FROM p",
}
