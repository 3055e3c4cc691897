"""The slop report: repetition, rhythm and vocabulary of one text, and a suspicion score.

Everything is a projection of the row: repeats are found in sorted arrays of hashes or keys, so nothing is shuffled however long
a text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .text import HEADED, _D, docs, headed, sql_block, sql_prose, sql_trim

# Fixed values.
TRIGRAMS = ("one of the", "as well as", "out of the", "it was a", "to be a", "in the same", "at the same", "was one of", "this is a", "there was a", "in order to", "the end of", "a lot of", "the rest of", "it is a", "for the first", "the beginning of")
BAD_WORDS = ("delve", "tapestry", "vibrant", "testament", "symphony")
DRAMATIC = (
    "blood", "fear", "grave", "ghost", "tomb", "dark", "hollow", "fatal", "doom", "despair",
    "metallic", "sterile", "iron", "claw", "clawed", "claws", "scream", "screamed", "shattered", "ruin",
    "infinite", "eternal", "perfect", "perfection", "obedience", "compliance", "unforgiving", "abyss", "haunting", "haunted",
)
EXPANSION = ("elaborated version", "expanded version", "revised version", "chapter rewrite", "version 2", "version ii")
OPTIMISATION = ("efficiency", "compliance", "optimization", "directive", "flagged")
HEADING = r"(?imd)^[\t\n\f\r ]*(chapter|ch\.?)[\t\n\f\r ]+([0-9ivxlcdm]+)[\t\n\f\r ]*[:\-]?[\t\n\f\r ]*(.+)?$"
FLAGS = (
    "Monotone: sentence-length variability is unusually low",
    "High red-flag vocabulary density",
    "Low Originality: trigram profile is overly common",
    "Verbatim repetition: large blocks are duplicated across the manuscript",
    "Repeated phrase lattice: long n-grams recur too frequently",
    "Uniform dramatic saturation: stylistic intensity is unusually constant",
    "Mechanical expansion markers detected (e.g., elaborated/duplicated chapter structure)",
    "AI-generation risk is high based on repetition and style-structure signals",
)


def share(words: Column, lexicon: tuple[str, ...]) -> Column:
    n = F.size(words)
    return F.when(n > 0, F.size(F.filter(words, lambda w: w.isin(*lexicon))) / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))


def common_trigrams(words: Column) -> Column:
    """Share of a text's trigrams that are among the common ones."""
    first = sorted({g.split()[0] for g in TRIGRAMS})
    known = lambda ws, w, i: w.isin(*first) & F.concat_ws(" ", w, F.get(ws, i + 1), F.get(ws, i + 2)).isin(*TRIGRAMS)
    found = T.let(words, lambda ws: F.size(F.filter(ws, lambda w, i: known(ws, w, i))))
    n = F.size(words) - 2
    return F.when(n > 0, found / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))


def repeated_share(ordered: Column) -> Column:
    """Share of a sorted array's elements that stand in it more than once: neighbours tell.

    The array must be a column already: what a lambda refers to is evaluated anew for each element.
    """
    n = F.size(ordered)
    twice = F.size(F.filter(ordered, lambda k, i: (k == F.get(ordered, i - 1)) | (k == F.get(ordered, i + 1))))
    return F.when(n > 0, twice / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))


def repeated_blocks(t: Column) -> Column:
    """struct(covered, blocks, most) of paragraphs of 35 words or more; one pass over the sorted keys. A text without two of these makes no keys, and what has fewer letters than 35 is not looked at."""
    long_ = F.filter(F.split(t, r"\n[\t\n\f\r ]*\n+"), lambda p: F.length(p) >= 35)
    counted = lambda ps: F.when(F.size(ps) > 1, F.filter(F.transform(ps, lambda p: F.struct(p.alias("p"), F.regexp_count(F.lower(p), F.lit("[a-z']+")).alias("n"))), lambda x: x["n"] >= 35))
    keyed = lambda xs: F.when(F.size(xs) > 1, F.array_sort(F.filter(F.transform(xs, lambda x: F.struct(T.normal_block(x["p"]).alias("key"), x["n"].alias("n"))), lambda x: x["key"] != "")))
    parts = F.coalesce(T.let(T.let(long_, counted), keyed), F.array().cast("array<struct<key:string,n:int>>"))
    state = lambda key, n, words, covered, blocks, most: F.struct(key.alias("key"), n.alias("n"), words.alias("words"), covered.alias("covered"), blocks.alias("blocks"), most.alias("most"))
    zero = F.lit(0)

    def closed(a: Column) -> tuple[Column, Column, Column]:
        many = a["n"] > 1
        return a["covered"] + F.when(many, a["words"] * a["n"]).otherwise(0), a["blocks"] + F.when(many, 1).otherwise(0), F.when(many, F.greatest(a["most"], a["n"])).otherwise(a["most"])

    def step(a: Column, p: Column) -> Column:
        return F.when(p["key"] == a["key"], state(p["key"], a["n"] + 1, F.greatest(a["words"], p["n"]), a["covered"], a["blocks"], a["most"])).otherwise(state(p["key"], F.lit(1), p["n"], *closed(a)))

    def end(a: Column) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip(closed(a), ("covered", "blocks", "most"))])

    return F.aggregate(parts, state(F.lit(""), zero, zero, zero, zero, zero), step, end)


def marks(t: Column, needles: tuple[str, ...]) -> Column:
    """Occurrences of the needles in a lowered text; one that is not there is looked for once."""
    return T.let(F.lower(t), lambda low: sum((F.when(F.contains(low, F.lit(m)), T.substring_count(low, m)).otherwise(0) for m in needles), F.lit(0)))


def heading_titles(t: Column) -> Column:
    """Sorted titles of headings, of ten letters or more."""
    return F.array_sort(F.filter(F.transform(T.find_all(t, HEADING, 3), T.normal_block), lambda x: F.length(x) >= 10))


def repeated_titles(ordered: Column) -> Column:
    """How many different elements of a sorted array stand in it more than once."""
    return F.size(F.filter(ordered, lambda x, i: (x == F.get(ordered, i + 1)) & ~F.coalesce(x == F.get(ordered, i - 1), F.lit(False))))


def suspicion(dup: Column, phrase: Column, blocks: Column, most: Column, mean: Column, sd: Column, expansion: Column, optimisation: Column) -> Column:
    whole = lambda x: F.floor(x).cast("int")
    score = F.least(F.lit(55), whole(dup * 180.0)) + F.least(F.lit(35), whole(phrase * 120.0))
    score = score + F.when(blocks > 0, F.least(F.lit(15), blocks * 3 + F.greatest(F.lit(0), most - 1) * 2)).otherwise(0)
    score = score + F.when((mean >= 0.05) & (sd <= 0.05), F.least(F.lit(15), whole(mean * 220.0))).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score + F.least(F.lit(10), expansion * 3) + F.least(F.lit(5), optimisation)))


def slop(rows: DataFrame, bad_words=BAD_WORDS, dramatic=DRAMATIC, phrase: int = 12, carried: tuple[str, ...] = ()) -> DataFrame:
    """rows(doc_id, text) -> the report, one row per document, with the columns carried; an empty text has zeros and is monotone."""
    t, w = F.col("text"), F.col("words")
    rows = rows.select("doc_id", "text", *carried, T.sentence_words(t).alias("sentences"))
    rows = rows.withColumn("words", F.flatten("sentences"))
    rows = rows.withColumn("lengths", F.filter(F.transform("sentences", lambda s: F.size(s).cast("double")), lambda n: n > 0))
    rows = rows.withColumn("drama", F.transform(F.filter("sentences", lambda s: F.size(s) >= 4), lambda s: share(s, dramatic)))
    rows = rows.withColumn("phrases", F.sort_array(T.gram_hashes(w, phrase))).withColumn("titles", heading_titles(t))
    sd, mean = T.sd_and_mean(F.col("lengths"))
    drama_sd, drama = T.sd_and_mean(F.col("drama"))
    expansion = marks(t, EXPANSION) + repeated_titles(F.col("titles"))
    rows = rows.select(
        "doc_id", *carried, F.size(w).alias("n_words"), F.size("sentences").alias("n_sentences"), sd.alias("sentence_sd"), mean.alias("sentence_mean"), share(w, bad_words).alias("bad_word_density"), common_trigrams(w).alias("trigram_share"), repeated_blocks(t).alias("r"),
        repeated_share(F.col("phrases")).alias("phrase_coverage"), drama.alias("drama_mean"), drama_sd.alias("drama_sd"), expansion.alias("expansion_markers"), marks(t, OPTIMISATION).alias("optimisation_markers"),
    )
    n = F.col("n_words")
    rows = rows.withColumn("dup_coverage", F.when(n > 0, F.col("r.covered") / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))).withColumn("repeated_blocks", F.col("r.blocks")).withColumn("max_repeat", F.col("r.most")).drop("r")
    c = F.col
    rows = rows.withColumn("score", suspicion(c("dup_coverage"), c("phrase_coverage"), c("repeated_blocks"), c("max_repeat"), c("drama_mean"), c("drama_sd"), c("expansion_markers"), c("optimisation_markers")))
    rules = (c("sentence_sd") < 4.0, c("bad_word_density") > 0.015, c("trigram_share") >= 0.90, (c("dup_coverage") >= 0.12) | (c("max_repeat") >= 3), c("phrase_coverage") >= 0.10, (c("drama_mean") >= 0.055) & (c("drama_sd") <= 0.04), c("expansion_markers") > 0, c("score") >= 45)
    flags = F.filter(F.array(*[F.when(r, F.lit(f)) for r, f in zip(rules, FLAGS)]), lambda f: f.isNotNull())
    return rows.withColumn("flags", flags).withColumn("likely_ai", c("score") >= 45)


def flat(report: DataFrame) -> DataFrame:
    kinds = dict(report.dtypes)
    return report.select(*[F.array_join(n, "|").alias(n) if n == "flags" else F.round(n, 6).alias(n) if kinds[n] == "double" else F.col(n) for n in report.columns])


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(slop(docs(spark, sf_dir))).select("doc_id", "n_words", "n_sentences", "sentence_mean", "sentence_sd", "bad_word_density", (F.col("sentence_sd") < 4.0).alias("monotone"))


def slop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(slop(docs(spark, sf_dir)))


def repeating(rows: DataFrame) -> DataFrame:
    """Texts that repeat: a block three times, headings twice, markers and drama put in; in two documents of three the block stands once."""
    t = F.col("text")
    block = F.when(F.col("doc_id") % 3 == 0, F.concat(t, F.lit("\n\n"), t, F.lit("\n \n"), t)).otherwise(t)
    made = F.concat(F.lit("Chapter 1: The Long Road Home\n"), block, F.lit("\n\nChapter 2 - The long road home\nThe revised version shows blood and fear in the dark abyss. Efficiency, compliance: one of the many tapestry. At the same time it was a delve.\nChapter 3\nThe long road home"))
    return rows.select("doc_id", made.alias("text"))


def slop_report_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(slop(repeating(docs(spark, sf_dir))))


def slop_report_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(slop(docs(spark, sf_dir), bad_words=("the", "de", "of"), dramatic=("and", "la", "der", "in"), phrase=4))


def slop_report_headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(slop(headed(docs(spark, sf_dir)))).select("doc_id", "n_words", "dup_coverage", "phrase_coverage", "expansion_markers", "score", "flags")


# --- DuckDB ---------------------------------------------------------------------------------------------------------------


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _count(x: str, needles) -> str:
    return " + ".join(f"(length({x}) - length(replace({x}, '{m}', ''))) // {len(m)}" for m in needles)


def sql_slop(source: str, bad_words=BAD_WORDS, dramatic=DRAMATIC, phrase: int = 12, columns: str = "*") -> str:
    heading = r"(?im)^\s*(chapter|ch\.?)\s+([0-9ivxlcdm]+)\s*[:\-]?\s*(.+)?$"
    rules = ("sd < 4.0", "bad > 0.015", "tri >= 0.90", "dup >= 0.12 OR most >= 3", "phrase >= 0.10", "dm >= 0.055 AND dsd <= 0.04", "expansion > 0", "score >= 45")
    flags = ", ".join(f"CASE WHEN {r} THEN '{f}' END" for r, f in zip(rules, FLAGS))
    return f"""
WITH d AS (SELECT doc_id, text, {sql_prose('text')} AS ws, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {sql_trim('s')}), lambda s: s <> '') AS ss FROM {source}),
se AS (SELECT doc_id, {sql_prose('s')} AS sw FROM (SELECT doc_id, unnest(ss) AS s FROM d)),
st AS (SELECT doc_id, coalesce(stddev_pop(len(sw)) FILTER (len(sw) > 0), 0) AS sd, coalesce(avg(len(sw)) FILTER (len(sw) > 0), 0) AS mean,
       coalesce(avg(len(list_filter(sw, lambda w: w IN {_in(dramatic)})) / len(sw)::DOUBLE) FILTER (len(sw) >= 4), 0) AS dm, coalesce(stddev_pop(len(list_filter(sw, lambda w: w IN {_in(dramatic)})) / len(sw)::DOUBLE) FILTER (len(sw) >= 4), 0) AS dsd FROM se GROUP BY doc_id),
pa AS (SELECT doc_id, {sql_block('p')} AS k, len({sql_prose('p')}) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n+')) AS p FROM d)),
pg AS (SELECT doc_id, k, count(*) AS c, max(n) AS m FROM pa WHERE n >= 35 AND k <> '' GROUP BY doc_id, k HAVING count(*) > 1),
pd AS (SELECT doc_id, sum(c * m) AS covered, count(*) AS blocks, max(c) AS most FROM pg GROUP BY doc_id),
ng AS (SELECT doc_id, array_to_string(ws[i:i + {phrase - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {phrase - 2})) AS i FROM d WHERE len(ws) >= {phrase})),
nc AS (SELECT doc_id, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c)::DOUBLE AS phrase FROM (SELECT doc_id, g, count(*) AS c FROM ng GROUP BY doc_id, g) GROUP BY doc_id),
hd AS (SELECT doc_id, count(*) AS heads FROM (SELECT doc_id, h FROM (SELECT doc_id, {sql_block('h')} AS h FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{heading}', 3)) AS h FROM d)) WHERE length(h) >= 10 GROUP BY doc_id, h HAVING count(*) > 1) GROUP BY doc_id),
a AS (SELECT d.doc_id, len(ws)::INT AS n_words, len(ss)::INT AS n_sentences, coalesce(sd, 0) AS sd, coalesce(mean, 0) AS mean, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: w IN {_in(bad_words)})) / len(ws)::DOUBLE ELSE 0 END AS bad,
      CASE WHEN len(ws) >= 3 THEN len(list_filter(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')), lambda g: g IN {_in(TRIGRAMS)})) / (len(ws) - 2)::DOUBLE ELSE 0 END AS tri,
      coalesce(phrase, 0) AS phrase, coalesce(dm, 0) AS dm, coalesce(dsd, 0) AS dsd, ({_count('lower(text)', EXPANSION)} + coalesce(heads, 0))::INT AS expansion, ({_count('lower(text)', OPTIMISATION)})::INT AS optimisation,
      CASE WHEN len(ws) > 0 THEN coalesce(covered, 0) / len(ws)::DOUBLE ELSE 0 END AS dup, coalesce(blocks, 0)::INT AS blocks, coalesce(most, 0)::INT AS most FROM d LEFT JOIN st USING (doc_id) LEFT JOIN pd USING (doc_id) LEFT JOIN nc USING (doc_id) LEFT JOIN hd USING (doc_id)),
s AS (SELECT *, greatest(0, least(100, least(55, floor(dup * 180.0::DOUBLE)) + least(35, floor(phrase * 120.0::DOUBLE)) + CASE WHEN blocks > 0 THEN least(15, blocks * 3 + greatest(0, most - 1) * 2) ELSE 0 END + CASE WHEN dm >= 0.05 AND dsd <= 0.05 THEN least(15, floor(dm * 220.0::DOUBLE)) ELSE 0 END + least(10, expansion * 3) + least(5, optimisation)))::INT AS score FROM a),
o AS (SELECT doc_id, n_words, n_sentences, round(sd, 6) AS sentence_sd, round(mean, 6) AS sentence_mean, round(bad, 6)::DOUBLE AS bad_word_density, round(tri, 6)::DOUBLE AS trigram_share, round(phrase, 6)::DOUBLE AS phrase_coverage, round(dm, 6)::DOUBLE AS drama_mean, round(dsd, 6)::DOUBLE AS drama_sd,
      expansion AS expansion_markers, optimisation AS optimisation_markers, round(dup, 6)::DOUBLE AS dup_coverage, blocks AS repeated_blocks, most AS max_repeat, score, array_to_string(list_filter([{flags}], lambda f: f IS NOT NULL), '|') AS flags, score >= 45 AS likely_ai FROM s)
SELECT {columns} FROM o"""


_REPEATING = f"""(SELECT doc_id, 'Chapter 1: The Long Road Home' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || chr(10) || text || chr(10) || ' ' || chr(10) || text ELSE text END || chr(10) || chr(10) || 'Chapter 2 - The long road home' || chr(10) || 'The revised version shows blood and fear in the dark abyss. Efficiency, compliance: one of the many tapestry. At the same time it was a delve.' || chr(10) || 'Chapter 3' || chr(10) || 'The long road home' AS text FROM {_D})"""
QUERIES = {"slop_sentence_stats": sentence_stats, "slop_report": slop_report, "slop_report_repeats": slop_report_repeats, "slop_report_lexicon": slop_report_lexicon, "slop_report_headed": slop_report_headed}
ORACLES = {
    "slop_sentence_stats": sql_slop(_D, columns="doc_id, n_words, n_sentences, sentence_mean, sentence_sd, bad_word_density, sentence_sd < 4.0 AS monotone"),
    "slop_report": sql_slop(_D),
    "slop_report_repeats": sql_slop(_REPEATING),
    "slop_report_lexicon": sql_slop(_D, ("the", "de", "of"), ("and", "la", "der", "in"), 4),
    "slop_report_headed": sql_slop(HEADED, columns="doc_id, n_words, dup_coverage, phrase_coverage, expansion_markers, score, flags"),
}
