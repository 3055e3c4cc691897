"""Language quality, safety and age heuristics, and their overlay by provider tables: projections of the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .slop import _in
from .text import _D, CLUSTER, VOWEL, docs, misspelled, sql_prose, sql_trim, turns

# Fixed values.
PROFANITY = ("fuck", "shit", "damn", "bitch", "asshole", "bastard")
EXPLICIT = ("sex", "nude", "naked", "erotic", "orgasm", "penetration")
VIOLENCE = ("blood", "kill", "murder", "gun", "knife", "stab", "violent")


def clamp100(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x.cast("int")))


def ratio(count: Column, factor: int, of: Column) -> Column:
    """count * factor / of, cut off."""
    return F.floor(count * factor / F.greatest(of, F.lit(1))).cast("int")


def age_category(profanity: Column, explicit: Column, violence: Column) -> Column:
    return F.when((explicit >= 8) | (profanity >= 10), "Adult 18+").when((explicit >= 4) | (profanity >= 6) | (violence >= 8), "Mature 16+").when((profanity >= 2) | (violence >= 4), "Teen 13+").otherwise("All Ages")


def language(rows: DataFrame, profanity=PROFANITY, explicit=EXPLICIT, violence=VIOLENCE, carried: tuple[str, ...] = ()) -> DataFrame:
    """rows(doc_id, text) -> scores, counts and notes, with the columns carried; a text without words has zeros and an unknown age."""
    t = F.col("text")
    rows = rows.select("doc_id", "text", *carried, T.prose_words(t).alias("words"), F.split(t, "[.!?]+").alias("parts"))
    rows = rows.withColumn("sentences", F.filter(F.transform("parts", T.trimmed), lambda s: s != "")).withColumn("lengths", F.transform("sentences", lambda s: T.count_all(s, "[A-Za-z']+")))
    n, parts = F.size("words"), F.size("parts")
    rows = rows.withColumn("listed", F.filter("words", lambda w: w.isin(*profanity, *explicit, *violence)))
    hits = lambda lexicon: F.size(F.filter("listed", lambda w: w.isin(*lexicon)))
    rows = rows.select(
        "doc_id", *carried, n.alias("n_words"), parts.alias("n_parts"), F.size(F.filter("words", misspelled)).alias("misspelled"),
        (F.size(F.filter("sentences", lambda s: s.rlike("^[a-z]"))) + F.size(F.filter("lengths", lambda x: x > 35)) + T.count_all(t, "[!?.,]{2,}") + T.count_all(t, r"[\t\n\f\r ]{2,}")).alias("grammar_issues"),
        (F.aggregate("lengths", F.lit(0), lambda a, x: a + x) / parts).alias("sentence_mean"), hits(profanity).alias("profanity_count"), hits(explicit).alias("explicit_count"), hits(violence).alias("violence_count"),
    )
    c = F.col
    scored = rows.select(
        "*", clamp100(100 - ratio(c("misspelled"), 300, c("n_words"))).alias("spelling"), clamp100(100 - ratio(c("grammar_issues"), 200, c("n_parts"))).alias("grammar"),
        clamp100(100 - F.floor(F.abs(c("sentence_mean") - 18.0) * 3.2).cast("int")).alias("readability"),
        clamp100(ratio(c("profanity_count"), 1000, c("n_words"))).alias("profanity"), clamp100(ratio(c("explicit_count"), 1200, c("n_words"))).alias("explicit"), clamp100(ratio(c("violence_count"), 900, c("n_words"))).alias("violence"),
    ).withColumn("age", age_category(c("profanity"), c("explicit"), c("violence")))
    notes = F.array(F.format_string("Average sentence length: %.1f words", "sentence_mean"), F.format_string("Potential spelling anomalies: %d", "misspelled"), F.format_string("Grammar issue heuristics triggered: %d", "grammar_issues"))
    some = c("n_words") > 0
    zero = ["misspelled", "grammar_issues", "sentence_mean", "profanity_count", "explicit_count", "violence_count", "spelling", "grammar", "readability", "profanity", "explicit", "violence"]
    return scored.select("doc_id", *carried, "n_words", *[F.when(some, c(x)).otherwise(F.lit(0).cast(dict(scored.dtypes)[x])).alias(x) for x in zero], F.when(some, c("age")).otherwise("Unknown").alias("age"), F.when(some, notes).otherwise(F.array().cast("array<string>")).alias("notes"))


def tool_scores(chaps: DataFrame, matches: DataFrame) -> DataFrame:
    """chapters and grammar-tool matches(doc_id, chapter, category) -> spelling, grammar, readability of each document."""
    words = chaps.groupBy("doc_id").agg(F.sum(F.size(T.fields(F.col("text")))).alias("n_words"))
    kind = F.upper("category")
    spell = kind.contains("TYPOS") | kind.contains("SPELL")
    counted = matches.groupBy("doc_id").agg(F.count_if(spell).alias("sp"), F.count_if(~spell & kind.contains("STYLE")).alias("st"), F.count_if(~spell & ~kind.contains("STYLE")).alias("gr"))
    all_ = words.join(counted, "doc_id", "left").fillna(0, ["sp", "st", "gr"])
    spelling, grammar = clamp100(100 - ratio(F.col("sp"), 700, F.col("n_words"))), clamp100(100 - ratio(F.col("gr") + F.col("st"), 900, F.col("n_words")))
    return all_.select("doc_id", "n_words", spelling.alias("spelling"), grammar.alias("grammar"), F.floor((spelling + grammar) / 2).cast("int").alias("readability"))


def overlaid(report: DataFrame, tool: DataFrame | None = None, safety: DataFrame | None = None) -> DataFrame:
    """The heuristic report with provider scores where there are any; heuristic_fallback tells whether one was missing."""
    used = {"tool": False, "safety": False}
    for name, table, columns in (("tool", tool, ("spelling", "grammar", "readability")), ("safety", safety, ("profanity", "explicit", "violence", "age"))):
        if table is not None:
            used[name] = True
            given = table.select("doc_id", *[F.col(x).alias(f"p_{x}") for x in columns], F.lit(True).alias(f"has_{name}"))
            report = report.join(given, "doc_id", "left")
            for x in columns:
                value = F.col("p_age") if x == "age" else clamp100(F.col(f"p_{x}"))
                value = F.when(F.col("p_age") == "", "Unknown").otherwise(value) if x == "age" else value
                report = report.withColumn(x, F.coalesce(value, x) if x == "age" else F.when(F.col(f"p_{x}").isNotNull(), value).otherwise(F.col(x)))
            report = report.drop(*[f"p_{x}" for x in columns])
    missing = F.lit(False)
    for name, there in used.items():
        missing = missing | (F.col(f"has_{name}").isNull() if there else F.lit(True))
    warning = F.lit("Heuristic fallback used for part of the language report.")
    out = report.withColumn("heuristic_fallback", missing).withColumn("notes", F.when(missing, F.concat(F.array(warning), "notes")).otherwise(F.col("notes")))
    return out.drop("has_tool", "has_safety")


def flat(report: DataFrame) -> DataFrame:
    return report.withColumn("sentence_mean", F.round("sentence_mean", 6)).drop("notes")


def language_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(language(docs(spark, sf_dir)))


LEXICA = (("the", "la"), ("of", "der"), ("and", "de", "to"))


def language_report_lexica(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(language(turns(spark, sf_dir).select(F.concat_ws("-", "doc_id", "chapter").alias("doc_id"), "text"), *LEXICA))


def language_tool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches made from the rows: a chapter with an odd number has a typo, every third a style match, every fifth another."""
    chaps = turns(spark, sf_dir)
    made = chaps.select("doc_id", "chapter", F.explode(F.filter(F.array(F.when(F.col("chapter") % 2 == 1, F.lit("TYPOS")), F.when(F.col("chapter") % 3 == 0, F.lit("STYLE")), F.when(F.col("chapter") % 5 == 0, F.lit("GRAMMAR"))), lambda x: x.isNotNull())).alias("category"))
    return tool_scores(chaps, made)


def sql_language(source: str, profanity=PROFANITY, explicit=EXPLICIT, violence=VIOLENCE) -> str:
    clamp = lambda x: f"greatest(0, least(100, {x}))::INT"
    hit = lambda v: f"len(list_filter(ws, lambda w: w IN {_in(v)}))"
    some = lambda x, kind="INT": f"CASE WHEN n > 0 THEN {x} ELSE 0 END::{kind}"
    return rf"""
WITH d AS (SELECT doc_id, text, {sql_prose('text')} AS ws, regexp_split_to_array(text, '[.!?]+') AS ps FROM {source}),
s AS (SELECT *, list_filter(list_transform(ps, lambda s: {sql_trim('s')}), lambda s: s <> '') AS ss FROM d),
a AS (SELECT doc_id, len(ws) AS n, len(ps) AS np, len(list_filter(ws, lambda w: strlen(w) > 2 AND (NOT regexp_matches(w, '{VOWEL}') OR regexp_matches(w, '{CLUSTER}')))) AS mis,
  len(list_filter(ss, lambda s: regexp_matches(s, '^[a-z]'))) + len(list_filter(ss, lambda s: len(regexp_extract_all(s, '[A-Za-z'']+')) > 35)) + len(regexp_extract_all(text, '[!?.,]{{2,}}')) + len(regexp_extract_all(text, '\s{{2,}}')) AS gi,
  coalesce(list_sum(list_transform(ss, lambda s: len(regexp_extract_all(s, '[A-Za-z'']+')))), 0) / len(ps)::DOUBLE AS mean, {hit(profanity)} AS pc, {hit(explicit)} AS ec, {hit(violence)} AS vc FROM s),
b AS (SELECT *, {clamp('pc * 1000 // greatest(n, 1)')} AS p, {clamp('ec * 1200 // greatest(n, 1)')} AS e, {clamp('vc * 900 // greatest(n, 1)')} AS v FROM a)
SELECT doc_id, n::INT AS n_words, {some('mis')} AS misspelled, {some('gi')} AS grammar_issues, round({some('mean', 'DOUBLE')}, 6) AS sentence_mean, {some('pc')} AS profanity_count, {some('ec')} AS explicit_count, {some('vc')} AS violence_count,
  {some(clamp('100 - mis * 300 // greatest(n, 1)'))} AS spelling, {some(clamp('100 - gi * 200 // np'))} AS grammar, {some(clamp('100 - floor(abs(mean - 18.0) * 3.2::DOUBLE)::INT'))} AS readability, {some('p')} AS profanity, {some('e')} AS explicit, {some('v')} AS violence,
  CASE WHEN n = 0 THEN 'Unknown' WHEN e >= 8 OR p >= 10 THEN 'Adult 18+' WHEN e >= 4 OR p >= 6 OR v >= 8 THEN 'Mature 16+' WHEN p >= 2 OR v >= 4 THEN 'Teen 13+' ELSE 'All Ages' END AS age FROM b"""


from .text import TURNS, sql_fields  # noqa: E402

QUERIES = {"language_report": language_report, "language_report_lexica": language_report_lexica, "language_tool_scores": language_tool_scores}
ORACLES = {
    "language_report": sql_language(_D),
    "language_report_lexica": sql_language(f"(SELECT doc_id || '-' || chapter AS doc_id, text FROM {TURNS})", *LEXICA),
    "language_tool_scores": f"""WITH c AS (SELECT doc_id, sum(len({sql_fields('text')}))::BIGINT AS n, count(*) FILTER (chapter % 2 = 1) AS sp, count(*) FILTER (chapter % 3 = 0) AS st, count(*) FILTER (chapter % 5 = 0) AS gr FROM {TURNS} GROUP BY doc_id),
s AS (SELECT *, greatest(0, least(100, 100 - sp * 700 // greatest(n, 1)))::INT AS spelling, greatest(0, least(100, 100 - (gr + st) * 900 // greatest(n, 1)))::INT AS grammar FROM c) SELECT doc_id, n AS n_words, spelling, grammar, ((spelling + grammar) // 2)::INT AS readability FROM s""",
}
