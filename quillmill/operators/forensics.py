"""Contradictions between chapters: attributes by pattern, conflicts by window functions, severity, issues and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .characters import IGNORED
from .text import TURNS, turns

E = T.EDGE
# Attribute -> pattern of name and value.
PATTERNS = {
    "eyes": rf"(?i){E}([A-Z][a-z]+){E}[^.\n]{{0,45}}{E}eyes{E}[^.\n]{{0,25}}{E}(blue|brown|green|hazel|gray|grey){E}",
    "age": rf"(?i){E}([A-Z][a-z]+){E}[^.\n]{{0,35}}{E}(?:age|aged){E}[^0-9\n]{{0,10}}([0-9]{{1,3}}){E}",
    "dead": rf"(?i){E}([A-Z][a-z]+){E}[^.\n]{{0,30}}{E}(dead|alive){E}",
}
#: Words of which a match holds one.
GATES = {"eyes": ("eyes",), "age": ("age",), "dead": ("dead", "alive")}


def canonical(name: Column, aliases: Column | None = None) -> Column:
    """The smallest of the trimmed lower-case name and aliases that is not empty; unknown if none is."""
    all_ = F.array(name) if aliases is None else F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.coalesce(F.array_min(F.filter(F.transform(all_, lambda n: F.lower(T.trimmed(n))), lambda n: n != "")), F.lit("unknown"))


def profiles(chaps: DataFrame) -> DataFrame:
    """chapters -> doc_id, chapter, name, attr, value: the last match of each attribute of a name in a chapter."""
    rows = chaps.select("doc_id", "chapter", F.explode_outer("facts" if "facts" in chaps.columns else facts_in(F.col("text"))).alias("x")).where("x IS NOT NULL").select("doc_id", "chapter", "x.*").where(~F.col("name").isin(*IGNORED))
    value = F.when(F.col("attr") == "age", F.col("value")).when(F.col("attr") == "dead", (F.lower("value") == "dead").cast("string")).otherwise(F.lower("value"))
    return rows.groupBy("doc_id", "chapter", "name", "attr").agg(F.max_by(value, "pos").alias("value"))


def facts_in(t: Column) -> Column:
    """array<struct<attr, pos, name, value>> of every match in a text."""
    return F.concat(*[_pairs(t, attr, pattern) for attr, pattern in PATTERNS.items()])


def _pairs(t: Column, attr: str, pattern: str) -> Column:
    """(attr, pos, name, value) of every match: the pattern runs once, and only where one of its words is there; a match begins with the name and ends with the value."""
    there = F.lit(False)
    for word in GATES[attr]:
        there = there | F.lower(t).contains(word)
    found = F.transform(T.find_all(t, pattern), lambda m, i: F.struct(F.lit(attr).alias("attr"), i.alias("pos"), F.regexp_extract(m, "^[A-Za-z]+", 0).alias("name"), F.regexp_extract(m, "[0-9A-Za-z]+$", 0).alias("value")))
    return F.when(there, found).otherwise(F.array().cast("array<struct<attr:string,pos:int,name:string,value:string>>"))


def severity(attr: Column) -> Column:
    return F.when(attr.isin("dead", "alive"), "HIGH").when(attr.isin("age", "name", "eyes"), "MED").otherwise("LOW")


def contradictions(facts: DataFrame) -> DataFrame:
    """facts(doc_id, chapter, name, attr, value[, aliases]) -> one row per conflict.

    A value conflicts if it differs from the first one of its entity and attribute; the chapter it is held against is the last
    one before that agreed with the first. So one window per entity and attribute does the work of the running memory.
    """
    aliases = F.col("aliases") if "aliases" in facts.columns else None
    rows = facts.select("doc_id", canonical(F.col("name"), aliases).alias("entity"), F.lower(T.trimmed(F.col("attr"))).alias("attr"), "chapter", "name", "value")
    w = Window.partitionBy("doc_id", "entity", "attr").orderBy("chapter", "name", "value")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.first(F.lower("value")).over(w)).withColumn("agrees", F.lower("value") == F.col("first"))
    rows = rows.withColumn("value_a", F.last(F.when(F.col("agrees"), F.col("value")), ignorenulls=True).over(before)).withColumn("chapter_a", F.last(F.when(F.col("agrees"), F.col("chapter")), ignorenulls=True).over(before))
    out = rows.where("NOT agrees").select("doc_id", "entity", "attr", "value_a", F.col("value").alias("value_b"), "chapter_a", F.col("chapter").alias("chapter_b"))
    text = F.format_string('%s changed for %s: "%s" in Ch%d but "%s" in Ch%d', "attr", "entity", "value_a", "chapter_a", "value_b", "chapter_b")
    return out.withColumn("severity", severity(F.col("attr"))).withColumn("description", text)


def plausible(rows: DataFrame) -> DataFrame:
    """Without deaths: alive first and dead in a later chapter is no conflict."""
    return rows.where(~((F.col("attr") == "dead") & (F.lower("value_a") == "false") & (F.lower("value_b") == "true") & (F.col("chapter_b") > F.col("chapter_a"))))


def health_issues(found: DataFrame, summaries: DataFrame) -> DataFrame:
    """Contradictions with issue ids, in order of entity, attribute and chapter, and the summaries of both chapters."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("entity", "attr", "chapter_b", "value_b"))
    rows = found.withColumn("issue_id", F.format_string("issue-%03d", number))
    for side in ("a", "b"):
        rows = rows.join(summaries.select("doc_id", F.col("chapter").alias(f"chapter_{side}"), F.col("summary").alias(f"summary_{side}")), ["doc_id", f"chapter_{side}"], "left").fillna("", [f"summary_{side}"])
    return rows


def tables(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, contradictions) as stored: entities are trimmed names, unknown for none, numbered by first appearance."""
    w = Window.partitionBy("doc_id").orderBy("entity", "attr", "chapter_b", "value_b")
    named = found.withColumn("ord", F.row_number().over(w)).withColumn("entity_name", F.when(T.trimmed(F.col("entity")) == "", "unknown").otherwise(T.trimmed(F.col("entity"))))
    entities = named.groupBy("doc_id", "entity_name").agg(F.min("ord").alias("first")).withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))).drop("first")
    stored = named.join(entities.withColumnRenamed("id", "entity_id"), ["doc_id", "entity_name"]).withColumnRenamed("ord", "id").drop("entity_name", "entity")
    return entities.select("doc_id", "id", F.col("entity_name").alias("name"), F.lit("[]").alias("aliases"), F.lit("{}").alias("attributes")), stored


def factual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation chapters with statements put in about eyes, ages and lives that change with the chapter."""
    c = F.col("chapter")
    colour = F.when(c % 3 == 0, "brown").when(c % 3 == 1, "blue").otherwise("Blue")
    said = F.concat(F.lit("\nJohn had bright eyes of "), colour, F.lit(".\nMary aged "), (c % 2 + 30).cast("string"), F.lit(" now.\nThe man was dead.\nJohn is "), F.when(c % 4 < 2, "alive").otherwise("dead"), F.lit(".\n"), F.when(c % 2 == 0, "john's eyes were Green.").otherwise(""))
    return turns(spark, sf_dir).withColumn("text", F.concat("text", said))


def forensic_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(factual(spark, sf_dir)).select("doc_id", "chapter", "name", "attr", "value")


def forensic_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plausible(contradictions(profiles(factual(spark, sf_dir))))


def aliased(facts: DataFrame) -> DataFrame:
    """Facts with aliases put in: two names of one person by a common alias, blanks and empty ones."""
    name = F.col("name")
    known = F.when(name == "John", F.array(F.lit(" The Captain "), F.lit(""))).when(name == "Mary", F.array(F.lit("the captain"), F.lit("Zoe"))).when(name == "man", F.array(F.lit("  ")))
    return facts.withColumn("aliases", known)


def forensic_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions where names are one person by their aliases."""
    return contradictions(aliased(profiles(factual(spark, sf_dir))))


def forensic_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    chaps = factual(spark, sf_dir)
    short = chaps.where("chapter % 5 <> 0").select("doc_id", "chapter", T.first_words(F.col("text"), 8).alias("summary"))
    return health_issues(plausible(contradictions(profiles(chaps))), short).drop("description", "severity")


def forensic_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, stored = tables(plausible(contradictions(profiles(factual(spark, sf_dir)))))
    per = stored.groupBy("doc_id", "entity_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return entities.join(per.withColumnRenamed("entity_id", "id"), ["doc_id", "id"])


_FACTUAL = f"""(SELECT doc_id, chapter, text || chr(10) || 'John had bright eyes of ' || CASE chapter % 3 WHEN 0 THEN 'brown' WHEN 1 THEN 'blue' ELSE 'Blue' END || '.' || chr(10) || 'Mary aged ' || (chapter % 2 + 30) || ' now.' || chr(10) || 'The man was dead.' || chr(10) || 'John is ' || CASE WHEN chapter % 4 < 2 THEN 'alive' ELSE 'dead' END || '.' || chr(10) || CASE WHEN chapter % 2 = 0 THEN 'john''s eyes were Green.' ELSE '' END AS text FROM {TURNS})"""
_SQLP = {k: p.replace(E, r"\b") for k, p in PATTERNS.items()}
_one = lambda k: f"SELECT doc_id, chapter, '{k}' AS attr, i AS pos, ns[i] AS name, vs[i] AS value FROM (SELECT doc_id, chapter, ns, vs, unnest(range(1, len(ns) + 1)) AS i FROM (SELECT doc_id, chapter, regexp_extract_all(text, '{_SQLP[k]}', 1) AS ns, regexp_extract_all(text, '{_SQLP[k]}', 2) AS vs FROM {_FACTUAL}))"
_ign = ", ".join(f"'{w}'" for w in IGNORED)
_PROFILES = f"pf AS (SELECT doc_id, chapter, name, attr, arg_max(CASE attr WHEN 'age' THEN value WHEN 'dead' THEN (lower(value) = 'dead')::VARCHAR ELSE lower(value) END, pos) AS value FROM ({' UNION ALL '.join(map(_one, PATTERNS))}) WHERE name NOT IN ({_ign}) GROUP BY doc_id, chapter, name, attr)"
_CON_OF = f"""{_PROFILES}, x AS (SELECT *, $E AS entity, first_value(lower(value)) OVER (PARTITION BY doc_id, $E, attr ORDER BY chapter, name, value) AS f FROM pf),
y AS (SELECT *, last_value(CASE WHEN lower(value) = f THEN value END IGNORE NULLS) OVER w AS value_a, last_value(CASE WHEN lower(value) = f THEN chapter END IGNORE NULLS) OVER w AS chapter_a FROM x WINDOW w AS (PARTITION BY doc_id, entity, attr ORDER BY chapter, name, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cn AS (SELECT doc_id, entity, attr, value_a, value AS value_b, chapter_a, chapter AS chapter_b FROM y WHERE lower(value) <> f $P)"""
_CON = _CON_OF.replace("$E", "lower(name)").replace("$P", "AND NOT (attr = 'dead' AND value_a = 'false' AND value = 'true' AND chapter > chapter_a)")
_ALIAS = "list_min(list_filter(list_transform(list_concat([name], CASE name WHEN 'John' THEN [' The Captain ', ''] WHEN 'Mary' THEN ['the captain', 'Zoe'] WHEN 'man' THEN ['  '] ELSE [] END), lambda n: lower(trim(n))), lambda n: n <> ''))"
_TOLD = """CASE WHEN attr IN ('dead', 'alive') THEN 'HIGH' WHEN attr IN ('age', 'name', 'eyes') THEN 'MED' ELSE 'LOW' END AS severity, format('{} changed for {}: "{}" in Ch{} but "{}" in Ch{}', attr, entity, value_a, chapter_a, value_b, chapter_b) AS description"""
QUERIES = {"forensic_profiles": forensic_profiles, "forensic_contradictions": forensic_contradictions, "forensic_issues": forensic_issues, "forensic_aliases": forensic_aliases, "forensic_tables": forensic_tables}
ORACLES = {
    "forensic_profiles": f"WITH {_PROFILES} SELECT * FROM pf",
    "forensic_contradictions": f"""WITH {_CON} SELECT *, CASE WHEN attr IN ('dead', 'alive') THEN 'HIGH' WHEN attr IN ('age', 'name', 'eyes') THEN 'MED' ELSE 'LOW' END AS severity, format('{{}} changed for {{}}: "{{}}" in Ch{{}} but "{{}}" in Ch{{}}', attr, entity, value_a, chapter_a, value_b, chapter_b) AS description FROM cn""",
    "forensic_aliases": f"WITH {_CON_OF.replace('$E', _ALIAS).replace('$P', '')} SELECT *, {_TOLD} FROM cn",
    "forensic_issues": f"WITH {_CON}, sm AS (SELECT doc_id, chapter, array_to_string(list_filter(regexp_split_to_array(text, '{T.WIDE}+'), lambda x: x <> '')[1:8], ' ') AS s FROM {_FACTUAL} WHERE chapter % 5 <> 0) SELECT cn.*, format('issue-{{:03d}}', row_number() OVER (PARTITION BY cn.doc_id ORDER BY entity, attr, chapter_b, value_b)) AS issue_id, coalesce(a.s, '') AS summary_a, coalesce(b.s, '') AS summary_b FROM cn LEFT JOIN sm a ON a.doc_id = cn.doc_id AND a.chapter = chapter_a LEFT JOIN sm b ON b.doc_id = cn.doc_id AND b.chapter = chapter_b",
    "forensic_tables": f"WITH {_CON}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY entity, attr, chapter_b, value_b) AS ord FROM cn), e AS (SELECT doc_id, entity, min(ord) AS first_id, count(*) AS n FROM o GROUP BY doc_id, entity) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_id)::INT AS id, entity AS name, '[]' AS aliases, '{{}}' AS attributes, n, first_id::INT AS first_id FROM e",
}
