"""The composite health score, verdicts and classes of a report, and the grouping of its errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import detector, language, slop
from .text import _D, docs, filled, releases

# Fixed values.
COMP_TITLES = (("The Silent Patient", "Blockbuster"), ("The Maidens", "Blockbuster"), ("Wrong Place Wrong Time", "Mid-list"), ("Rock Paper Scissors", "Mid-list"), ("Unknown", "Unknown"))
ERROR_GROUPS = 8


def ai_penalty(p_doc: Column, cov: Column, p_max: Column, flags: Column, slop_score: Column) -> Column:
    base = F.round(p_max * 35.0 + F.greatest(F.lit(0.0), cov - 0.10) * 40.0).cast("int")
    base = base + F.when((p_doc >= 0.85) & ((p_max >= 0.75) | (cov >= 0.25)), 8).otherwise(0) + F.when(F.array_contains(flags, "ai_chunk_detected"), 10).otherwise(0) + F.when(F.array_contains(flags, "widespread_ai_signal"), 15).otherwise(0)
    known = p_doc.isNotNull() & cov.isNotNull() & p_max.isNotNull()
    return F.when(known, F.least(F.lit(70), base)).otherwise(F.floor(slop_score / 5).cast("int"))


def health(issues: Column, n_flags: Column, grammar: Column, spelling: Column, penalty: Column) -> Column:
    fifth = lambda x: F.floor((100 - x) / 5).cast("int")
    return F.greatest(F.lit(0), 100 - issues * 10 - n_flags * 6 - fifth(grammar) - fifth(spelling) - penalty)


def composite(ai: DataFrame, slop_: DataFrame, lang: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Reports by doc_id -> doc_id, ai_penalty, score, and the classes the report view shows."""
    rows = ai.select("doc_id", "p_ai_doc", "ai_coverage_est", "p_ai_max", "confidence_doc", F.col("flags").alias("ai_flags"))
    rows = rows.join(slop_.select("doc_id", F.col("score").alias("slop_score"), F.size("flags").alias("n_flags")), "doc_id").join(lang.select("doc_id", "grammar", "spelling"), "doc_id")
    rows = rows.withColumn("issues", F.lit(0)) if issues is None else rows.join(issues.groupBy("doc_id").agg(F.count("*").cast("int").alias("issues")), "doc_id", "left").fillna(0, ["issues"])
    c = F.col
    rows = rows.withColumn("ai_penalty", ai_penalty(c("p_ai_doc"), c("ai_coverage_est"), c("p_ai_max"), c("ai_flags"), c("slop_score")))
    rows = rows.withColumn("score", health(c("issues"), c("n_flags"), c("grammar"), c("spelling"), c("ai_penalty")))
    risk = lambda x, at: F.when(c(x) >= at, "high").otherwise("low")
    return rows.select("doc_id", "ai_penalty", "score", risk("p_ai_doc", 0.5).alias("doc_class"), risk("ai_coverage_est", 0.35).alias("coverage_class"), risk("p_ai_max", 0.85).alias("max_class"), F.when(c("confidence_doc") >= 0.5, "sure").otherwise("unsure").alias("confidence_class"), F.when(c("score") >= 70, "healthy").otherwise("risk").alias("health_class"))


def comp_titles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMP_TITLES, "title string, tier string")


def error_groups(errors: DataFrame, most: int = ERROR_GROUPS) -> DataFrame:
    """errors(doc_id, ord, stage, type, message) -> the first `most` groups in order of appearance, and how many are left out."""
    groups = errors.groupBy("doc_id", "stage", "type", "message").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    all_ = Window.partitionBy("doc_id")
    ranked = groups.withColumn("rank", F.row_number().over(all_.orderBy("first"))).withColumn("left_out", F.greatest(F.lit(0), F.count("*").over(all_) - most))
    return ranked.where(F.col("rank") <= most).drop("first")


def tool_error(message: Column) -> Column:
    """The kind of a provider's failure, by its message."""
    m = F.lower(message)
    return F.when(m.contains("timeout") | m.contains("deadline"), "timeout").when(m.contains("refused") | m.contains("unavailable") | m.contains("no such host"), "tool_unavailable").otherwise("exception")


def evidence_counts(signals: DataFrame, span: int = 250) -> DataFrame:
    """Windows with duplicate evidence, and with a long duplicate span, of each document."""
    return signals.groupBy("doc_id").agg(F.count_if(F.col("evidence") > 0).alias("with_evidence"), F.count_if(F.col("longest") >= span).alias("with_long_span"))


def health_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filled(detector.shared(docs(spark, sf_dir), detector.DetectorConfig(), "text"))
    return releases(composite(detector.detect(rows), slop.slop(rows), language.language(rows)), rows)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filled(detector.shared(docs(spark, sf_dir), detector.SMALL))
    return releases(evidence_counts(detector.window_signals(rows, detector.SMALL), detector.SMALL.long_dup_override_words), rows)


def error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as errors: users as documents, types as stages, a part of the properties as messages."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 50).alias("doc_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("stage"), (F.col("event_id") % 3).cast("string").alias("type"), F.when(F.col("event_id") % 2 == 0, "Timeout of the tool").otherwise("connection refused").alias("message"))
    return error_groups(rows).withColumn("kind", tool_error(F.col("message")))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp_titles(spark)


_AI = detector.sql_report(_D, detector.DetectorConfig()).replace("round(pd, 6)", "pd").replace("round(cov, 6)", "cov").replace("round(pm, 6)", "pm").replace("round(cf, 6)", "cf")
QUERIES = {"health_scores": health_scores, "evidence_counts": evidence, "error_groups": error_table, "comp_titles": titles}
ORACLES = {
    "health_scores": f"""WITH ai AS ({_AI}), sl AS ({slop.sql_slop(_D)}), la AS ({language.sql_language(_D)}),
j AS (SELECT ai.*, sl.score AS ss, CASE WHEN sl.flags = '' THEN 0 ELSE len(string_split(sl.flags, '|')) END AS nf, grammar, spelling FROM ai JOIN sl USING (doc_id) JOIN la USING (doc_id)),
p AS (SELECT *, CASE WHEN p_ai_doc IS NULL THEN ss // 5 ELSE least(70, round(p_ai_max * 35 + greatest(0, ai_coverage_est - 0.10::DOUBLE) * 40)::INT + CASE WHEN p_ai_doc >= 0.85 AND (p_ai_max >= 0.75 OR ai_coverage_est >= 0.25) THEN 8 ELSE 0 END + CASE WHEN contains(flags, 'ai_chunk_detected') THEN 10 ELSE 0 END + CASE WHEN contains(flags, 'widespread_ai_signal') THEN 15 ELSE 0 END) END AS pen FROM j),
s AS (SELECT *, greatest(0, 100 - nf * 6 - (100 - grammar) // 5 - (100 - spelling) // 5 - pen)::INT AS score FROM p)
SELECT doc_id, pen::INT AS ai_penalty, score, CASE WHEN p_ai_doc >= 0.5 THEN 'high' ELSE 'low' END AS doc_class, CASE WHEN ai_coverage_est >= 0.35 THEN 'high' ELSE 'low' END AS coverage_class, CASE WHEN p_ai_max >= 0.85 THEN 'high' ELSE 'low' END AS max_class, CASE WHEN confidence_doc >= 0.5 THEN 'sure' ELSE 'unsure' END AS confidence_class, CASE WHEN score >= 70 THEN 'healthy' ELSE 'risk' END AS health_class FROM s""",
    "evidence_counts": f"WITH {detector.sql_signals(_D, detector.SMALL)} SELECT doc_id, count(*) FILTER (evidence > 0) AS with_evidence, count(*) FILTER (longest >= 40) AS with_long_span FROM sig GROUP BY doc_id",
    "error_groups": "WITH e AS (SELECT user_id % 50 AS doc_id, event_id AS ord, event_type AS stage, (event_id % 3)::VARCHAR AS type, CASE WHEN event_id % 2 = 0 THEN 'Timeout of the tool' ELSE 'connection refused' END AS message FROM events), g AS (SELECT doc_id, stage, type, message, count(*) AS n, min(ord) AS f FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f)::INT AS rank, greatest(0, count(*) OVER (PARTITION BY doc_id) - 8) AS left_out FROM g) SELECT doc_id, stage, type, message, n, rank, left_out, CASE WHEN message LIKE 'Timeout%' THEN 'timeout' ELSE 'tool_unavailable' END AS kind FROM r WHERE rank <= 8",
    "comp_titles": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in COMP_TITLES) + ") t(title, tier)",
}
