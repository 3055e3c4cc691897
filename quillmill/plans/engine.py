"""The whole analysis of a corpus of manuscripts: flat tables by operator, and one nested report per manuscript."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..functions import providers
from ..functions import text as T
from ..operators import characters, detector, forensics, genre, language, scoring, slop, structure, text, timeline
from ..operators.text import _D, docs, sql_fields
from ..streaming.logs import Trace, progress

EMPTY = {"title": "No Manuscript Loaded", "status": "IDLE", "age": "Unknown"}


class Tables(dict):
    """Lazy tables by name; the measures of texts and of chapters, which they share, are kept as long as this is used, or until release()."""

    def __init__(self, tables: dict[str, DataFrame], *shared: DataFrame):
        super().__init__(tables)
        self.shared = shared
        text.releases(self, *shared)

    def fill(self) -> "Tables":
        """What they share is computed at once, each part by one executor."""
        for table in self.shared:
            text.filled(table)
        return self

    def release(self) -> None:
        for table in self.shared:
            table.unpersist()


def analyze(manuscripts: DataFrame, config: DetectorConfig = DetectorConfig(), given: dict[str, DataFrame] | None = None) -> Tables:
    """manuscripts(doc_id, title, lang, text) -> lazy tables by name.

    Texts are read and made into tokens once, chapters split and passed over once, for all tables but the segments, which read the texts again. What chapters were found to hold feeds the chapter tables; slop, ai and language depend on the
    text alone and are made in the same pass, so what is kept holds each text once, as its chapters. given: tables lt and lm (scores of
    windows), tool and safety (scores of texts), genre and plot (answers, see ask_genres and ask_plots).
    """
    p = given or {}
    texts, manuscripts = manuscripts, _measured(manuscripts, config)
    chaps = text.chapters(manuscripts)
    noted = text.kept(_noted(chaps))
    found = noted.select("doc_id", "chapter", "title", "events", "summary", "names")
    metrics = structure.chapter_metrics(noted)
    line = timeline.timeline(noted, found)
    conflicts = forensics.plausible(forensics.contradictions(forensics.profiles(noted)))
    issues = forensics.health_issues(conflicts, found)
    slop_, signals = manuscripts.select("doc_id", "slop.*"), detector.window_signals(manuscripts, config, p.get("lt"), p.get("lm"))
    ai = detector.document_report(manuscripts, signals, config)
    lang = language.overlaid(manuscripts.select("doc_id", "language.*"), p.get("tool"), p.get("safety"))
    scored = noted.select("doc_id", "chapter", "genres")
    if "genre" in p:
        scored = genre.decided(scored, p["genre"])
    own_beats = structure.beats(noted, found, metrics, line)
    named = scored if "provider" in scored.columns else scored.withColumn("provider", F.lit("heuristic"))
    tables = {
        "chapters": chaps, "segments": text.segments(texts), "metrics": metrics, "summaries": found, "characters": characters.dictionary(noted), "genres": genre.rolled_up(scored), "genre_reasons": genre.reasons(scored), "genre_providers": genre.dominant(named.select("doc_id", "provider")), "structure": structure.decided(noted, p.get("plot")),
        "slop": slop_, "windows": signals, "evidence": detector.window_evidence(manuscripts, signals, config), "ai": ai, "contradictions": conflicts, "issues": issues, "timeline": line, "beats": structure.overlaid(own_beats, p["plot"], chaps) if "plot" in p else own_beats, "language": lang, "scores": scoring.composite(ai, slop_, lang, issues),
    }
    return Tables(tables, manuscripts, noted)


def _noted(chaps: DataFrame) -> DataFrame:
    """What the chapter tables need of each chapter, in one pass over its text, which is not kept a second time: doc_id, chapter, title, events, summary, names, cast, genres, n_words, markers, head, facts."""
    t = F.col("text")
    rows = genre.scores(characters.events(chaps))
    rows = rows.select(
        "doc_id", "chapter", "title", "events", characters.summary(F.col("events"), t).alias("summary"), characters.names(t).alias("names"), "rated", "genres",
        F.size(T.fields(t)).alias("n_words"), timeline.markers(t).alias("markers"), T.first_words(t, structure.HEAD_WORDS).alias("head"), forensics.facts_in(t).alias("facts"),
    )
    return characters.with_cast(rows).drop("rated")


def _measured(manuscripts: DataFrame, config: DetectorConfig) -> DataFrame:
    """doc_id, title, lang, word_count, chapters, slop, language and detector of each manuscript, kept(); its text is there as chapters only."""
    names = [x for x in ("title", "lang") if x in manuscripts.columns]
    rows = manuscripts.select("doc_id", *names, "text", F.size(T.fields(F.col("text"))).alias("word_count"))
    for name, made in (("slop", slop.slop), ("language", language.language)):
        held = rows.select("doc_id", "text", F.struct("*").alias("_row"))
        found = made(held, carried=("_row",))
        rows = found.select("_row.*", F.struct(*[x for x in found.columns if x not in ("doc_id", "_row")]).alias(name))
    rows = rows.withColumn("chapters", text.chapter_list(F.col("text")))
    return detector.shared(rows, config, *[x for x in rows.columns if x not in ("doc_id", "lang", "text")])


def report(manuscripts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per manuscript: its flat results as structs, its rows as sorted arrays."""
    manuscripts = tables.shared[0] if isinstance(tables, Tables) else manuscripts

    def nested(name: str, *order: str) -> DataFrame:
        t = tables[name]
        rest = [c for c in t.columns if c not in ("doc_id", *order)]
        return t.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))

    count = F.col("word_count") if isinstance(tables, Tables) else F.size(T.fields(F.col("text")))
    rows = manuscripts.select("doc_id", "title", count.alias("word_count")).withColumn("n_segments", text.segment_count(F.col("word_count")))
    for name in ("slop", "ai", "language", "scores", "structure"):
        t = tables[name]
        rows = rows.join(t.select("doc_id", F.struct(*[c for c in t.columns if c != "doc_id"]).alias(name)), "doc_id", "left")
    for name, order in (("evidence", ["w", "ord"]), ("metrics", ["chapter"]), ("summaries", ["chapter"]), ("characters", ["name"]), ("genres", ["rank"]), ("issues", ["issue_id"]), ("timeline", ["ord"]), ("beats", ["beat"])):
        rows = rows.join(nested(name, *order), "doc_id", "left")
    rows.tables = tables  # what they share is kept with the report
    return rows


def save(tables: dict[str, DataFrame], folder: str, trace: Trace | None = None, every: float | None = None) -> dict[str, DataFrame]:
    """Each table as Parquet below the folder, read back: what is built on them later does not compute them again. The trace is told of every table, of a failure, and every so many seconds of the tasks done."""
    trace = trace or Trace()
    saved = {}
    for i, (name, table) in enumerate(tables.items()):
        trace(100 * i // len(tables), name, "writing")
        path = f"{folder.rstrip('/')}/{name}"
        with progress(table.sparkSession, trace, name, 100 * i // len(tables), 100 * (i + 1) // len(tables), every):
            table.write.mode("overwrite").parquet(path)
        saved[name] = table.sparkSession.read.schema(table.schema).parquet(path)
    trace(100, "done", f"{len(tables)} tables")
    return saved


def empty_report(spark: SparkSession) -> DataFrame:
    """The report before anything is read: its schema, one row of zeros."""
    none = spark.createDataFrame([(0, EMPTY["title"], "en", "")], "doc_id long, title string, lang string, text string")
    full = report(none, analyze(none))
    return _with(full.withColumn("status", F.lit(EMPTY["status"])), full)


def prompt_plots(metrics: DataFrame, summaries: DataFrame, line: DataFrame) -> DataFrame:
    """doc_id, prompt: what a plot provider is asked, with up to 12 anchors and each chapter's summary, metrics and events."""
    anchors = line.where("ord <= 12").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.concat("time_marker", F.lit(": "), T.first_words(F.col("event"), 16)).alias("t")))).alias("a"))
    told = summaries.join(metrics.select("doc_id", "chapter", "n_words", "n_markers", "top_genre"), ["doc_id", "chapter"])
    entry = F.concat(F.lit("Chapter "), F.col("chapter"), F.lit(" ("), F.col("n_words"), F.lit(" words, "), F.col("n_markers"), F.lit(" markers, "), F.col("top_genre"), F.lit("): "), T.first_words(F.col("summary"), 30), F.lit(" Events: "), F.array_join(F.slice("events", 1, 4), "; "))
    chapters = told.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chapter", entry.alias("t")))).alias("c"))
    head = F.lit("Judge which plot structure fits. Answer in JSON with probabilities and beats.\n")
    return chapters.join(anchors, "doc_id", "left").select("doc_id", F.concat(head, F.lit("Timeline:\n"), F.coalesce(F.array_join("a.t", "\n"), F.lit("")), F.lit("\nChapters:\n"), F.array_join("c.t", "\n")).alias("prompt"))


def ask_genres(chaps: DataFrame, model: Callable[[str], str] | None, seconds: float | None = 120.0) -> DataFrame:
    """The table genre of analyze(): a model's answer on a sample of each chapter; three failed chapters in a row end a manuscript's asking."""
    prompt = providers.genre_prompt(text.genre_sample(F.col("text")), genre.ORDER)
    return providers.ask(chaps.select("doc_id", "chapter", prompt.alias("prompt")), ["doc_id", "chapter"], "prompt", model, failures=3, seconds=seconds)


def ask_plots(tables: dict[str, DataFrame], model: Callable[[str], str] | None, seconds: float | None = 120.0) -> DataFrame:
    """The table plot of analyze(): a model's answer on each manuscript's chapters, from the tables of an analysis without it."""
    prompts = prompt_plots(tables["metrics"], tables["summaries"], tables["timeline"])
    return providers.ask(prompts, ["doc_id"], "prompt", model, tries=1, seconds=seconds)


def manuscript_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report of every document, as JSON."""
    rows = docs(spark, sf_dir).withColumn("title", F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    full = report(rows, analyze(rows).fill())
    return _with(full.select("doc_id", "word_count", F.to_json(F.struct(*[c for c in full.columns if c != "doc_id"])).alias("report")), full)


def report_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single values of the nested report, taken out of it again."""
    rows = docs(spark, sf_dir).withColumn("title", F.lit("T"))
    full = report(rows, analyze(rows).fill())
    c = F.col
    scalars = full.select(
        "doc_id", "word_count", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), c("slop.score").alias("slop_score"), c("slop.n_sentences").alias("n_sentences"), F.round("ai.p_ai_doc", 6).alias("p_ai_doc"), c("ai.n_windows").alias("n_windows"),
        c("ai.likely_ai").alias("likely_ai"), c("language.spelling").alias("spelling"), c("language.grammar").alias("grammar"), c("structure.selected").alias("structure"), F.size("beats").alias("n_beats"),
    )
    return _with(scalars, full)


def _with(rows: DataFrame, full: DataFrame) -> DataFrame:
    """rows made of a report, which keep what that keeps."""
    rows.tables = full.tables
    return rows


QUERIES = {"manuscript_reports": manuscript_reports, "report_scalars": report_scalars}
ORACLES = {
    "report_scalars": f"""WITH w AS (SELECT doc_id, len({sql_fields('text')})::INT AS n FROM {_D}), s AS ({slop.sql_slop(_D)}), a AS ({detector.sql_report(_D, DetectorConfig())}), l AS ({language.sql_language(_D)})
SELECT w.doc_id, n AS word_count, CASE WHEN n = 0 THEN 0 WHEN n <= 1500 THEN 1 ELSE 1 + ceil((n - 1500) / 1300.0)::INT END::INT AS n_segments, s.score AS slop_score, s.n_sentences, a.p_ai_doc, a.n_windows, a.likely_ai, l.spelling, l.grammar, 'Save the Cat' AS structure, 3 AS n_beats
FROM w JOIN s USING (doc_id) JOIN a USING (doc_id) JOIN l USING (doc_id)"""
}
