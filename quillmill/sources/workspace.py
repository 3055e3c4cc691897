"""Workspaces, project ids, file names, and the report, table and snapshot sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators.text import _D, docs
from . import transactions

FOLDERS = ("configs", "cache/embeddings", "projects")
SETTINGS = {"theme": "dark", "default_model": ""}
SOURCE = "source.docx"


def ensure(base: str) -> str:
    """The workspace folders and default settings, made where they are missing (driver side)."""
    for folder in FOLDERS:
        Path(base, folder).mkdir(parents=True, exist_ok=True)
    settings = Path(base, "configs", "settings.json")
    if not settings.exists():
        settings.write_text(json.dumps(SETTINGS, indent=2))
    return base


def project_id(title: Column) -> Column:
    """Twelve hex digits of the SHA-256 of the trimmed lower-case title."""
    return F.substring(F.sha2(F.lower(T.trimmed(title)), 256), 1, 12)


def source_name(name: Column) -> Column:
    """The last part of a path, without double dots; a default for none."""
    trimmed = T.trimmed(F.coalesce(name, F.lit("")))
    base = F.regexp_extract(F.regexp_replace(trimmed, "/+$", ""), "([^/]*)$", 1)
    return F.when(base.isin("", "."), SOURCE).otherwise(F.replace(base, F.lit(".."), F.lit("")))


def file_stem(s: Column) -> Column:
    """Lower case, other characters than a-z and 0-9 as hyphens, none at the ends, double hyphens halved once."""
    return F.replace(F.regexp_replace(F.regexp_replace(F.lower(T.trimmed(s)), "[^a-z0-9]", "-"), "^-+|-+$", ""), F.lit("--"), F.lit("-"))


def create_project(root: str, title: str, name: str, content: bytes) -> Path:
    """A project folder with its source and, if there is none yet, an empty report (driver side, one manuscript)."""
    import hashlib

    folder = Path(root, "projects", hashlib.sha256(title.strip().lower().encode()).hexdigest()[:12])
    folder.mkdir(parents=True, exist_ok=True)
    base = Path(name.strip()).name
    (folder / (("" if base == "." else base.replace("..", "")) or SOURCE)).write_bytes(content)
    report = folder / "report.json"
    if not report.exists():
        report.write_text(json.dumps({"title": title, "analysis": None}, indent=2))
    return folder


def create_projects(manuscripts: DataFrame, root: str) -> DataFrame:
    """manuscripts(title, name, content) -> project_id, title, source_name, one row per project; any number of projects in one job for each of two writes.

    Sources go to <root>/sources/project_id=<id>, replaced where they are there; of manuscripts with one id the one of the largest name and content
    is taken. Reports go to <root>/reports/project_id=<id> as JSON, made only where the listing has none. Both are Spark's own partitioned
    writes, so any file system that it knows will do.
    """
    spark = manuscripts.sparkSession
    named = manuscripts.select(project_id(F.col("title")).alias("project_id"), "title", source_name(F.col("name")).alias("source_name"), "content")
    best = F.struct("source_name", "title", "content")
    rows = named.groupBy("project_id").agg(F.max(best).alias("x")).select("project_id", "x.*")
    rows.repartition("project_id").sortWithinPartitions("project_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(f"{root}/sources")
    made = spark.read.parquet(f"{root}/sources").select(F.col("project_id").cast("string"), "title", "source_name")
    own = named.select("project_id").distinct()
    seeds = made.join(own, "project_id", "left_semi").join(reported(spark, root), "project_id", "left_anti")
    told = seeds.select("project_id", "title", F.lit(None).cast("string").alias("analysis"))
    told.repartition("project_id").sortWithinPartitions("project_id").write.mode("append").option("ignoreNullFields", False).partitionBy("project_id").json(f"{root}/reports")
    return made.join(own, "project_id", "left_semi")


def reported(spark: SparkSession, root: str) -> DataFrame:
    """project_id of the projects that have a report, from the listing of the files alone."""
    none = spark.range(0).select(F.lit("").alias("project_id"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/reports")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return none
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(f"{root}/reports").select("path")
    return none.unionByName(files.select(F.regexp_extract("path", "project_id=([0-9a-f]{12})/", 1).alias("project_id")).distinct())


def save_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines, replacing what is there."""
    reports.write.mode("overwrite").json(path)


def save_tables(entities: DataFrame, contradictions: DataFrame, database: str | None = None) -> None:
    """Both tables replaced; their schema is made with them."""
    prefix = f"{database}." if database else ""
    for name, table in (("entities", entities), ("contradictions", contradictions)):
        table.write.mode("overwrite").format("parquet").saveAsTable(prefix + name)


def commit_tables(entities: DataFrame, contradictions: DataFrame, root: str) -> int:
    """Both tables replaced in one transaction, or neither: see transactions."""
    return transactions.commit(entities.sparkSession, root, {"entities": entities, "contradictions": contradictions})


def ensure_tables(spark: SparkSession, entities: StructType, contradictions: StructType, database: str | None = None) -> None:
    """Both tables, empty, where they are not there yet; what is there stays."""
    prefix = f"{database}." if database else ""
    for name, schema in (("entities", entities), ("contradictions", contradictions)):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet")


def count_rows(spark: SparkSession, table: str) -> int:
    return spark.table(table).count()


def save_snapshot(report: DataFrame, folder: str, stamp: str, run: str, trigger: str) -> str:
    """A run's report as a JSON file in a folder named by time, run and what set it off."""
    clean = lambda s: "".join(c if c.isascii() and c.isalnum() else "-" for c in s.strip().lower()).strip("-").replace("--", "-")
    path = f"{folder.rstrip('/')}/{stamp}_{clean(run)}_{clean(trigger)}"
    report.coalesce(1).write.mode("overwrite").json(path)
    return path


def project_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit(" "), T.first_words(F.col("text"), 4), F.lit("\t"))
    return docs(spark, sf_dir).select("doc_id", project_id(title).alias("project_id"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", source_name(F.regexp_replace("url", "[?#].*$", "")).alias("source_name"), file_stem(F.col("url")).alias("stem"), source_name(F.concat(F.lit("a/.."), F.col("page_id").cast("string"), F.lit("..docx"))).alias("dotted"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in ("documents", "conversations", "benchmark")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


QUERIES = {"project_ids": project_ids, "file_names": file_names, "table_counts": table_counts}
ORACLES = {
    "project_ids": f"SELECT doc_id, substr(sha256(lower(array_to_string(list_filter(regexp_split_to_array(text, '{T.WIDE}+'), lambda x: x <> '')[1:4], ' '))), 1, 12) AS project_id FROM {_D}",
    "file_names": "WITH u AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) AS b FROM pages) SELECT page_id, CASE WHEN b IN ('', '.') THEN 'source.docx' ELSE replace(b, '..', '') END AS source_name, replace(trim(regexp_replace(lower(url), '[^a-z0-9]', '-', 'g'), '-'), '--', '-') AS stem, page_id || 'docx' AS dotted FROM u",
    "table_counts": "SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'benchmark', count(*) FROM benchmark",
}
