"""Genre scores by keywords, their roll-up over chapters, reasons, and the mode of providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .slop import _count
from .text import _D, TURNS, docs, turns

# Fixed values; this order also breaks ties.
KEYWORDS = {
    "Thriller": ("murder", "chase", "conspiracy", "killer", "threat", "secret", "escape", "investigation", "spy"),
    "Mystery": ("clue", "detective", "evidence", "suspect", "crime", "missing", "investigate", "alibi"),
    "Romance": ("love", "kiss", "heart", "desire", "romance", "wedding", "passion", "affair"),
    "Fantasy": ("magic", "kingdom", "sword", "dragon", "spell", "prophecy", "portal", "myth"),
    "Sci-Fi": ("ship", "quantum", "android", "orbit", "signal", "colony", "lab", "protocol", "variant"),
    "Literary": ("memory", "silence", "family", "identity", "childhood", "grief", "dream", "voice"),
}
ORDER = tuple(KEYWORDS)
LEAST, TOP, REASON_BYTES = 0.001, 4, 2400
#: Keywords that the pseudo-words of test texts do hold.
FREQUENT = {"Thriller": ("the", "an"), "Mystery": ("in", "ou"), "Romance": ("er", "st"), "Fantasy": ("la", "ra"), "Sci-Fi": ("ch", "un"), "Literary": ("ing", "ado")}


def normalised(values: list[Column], names=ORDER) -> Column:
    """array<struct<name, score>> in order of score, ties in the order of names."""
    total = sum(values[1:], values[0])
    made = F.array(*[F.struct((-(v / total)).alias("down"), F.lit(i).alias("place"), F.lit(n).alias("name"), (v / total).alias("score")) for i, (n, v) in enumerate(zip(names, values))])
    return F.transform(F.array_sort(made), lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score")))


def scores(rows: DataFrame, keywords=KEYWORDS) -> DataFrame:
    """rows + genres: one plus the keyword hits of each genre over their sum, best first; a keyword that is not there is looked for once. Rows that have genres already stay as they are."""
    if "genres" in rows.columns:
        return rows
    low = rows.withColumn("lower", F.lower("text"))
    counted = low.select(*rows.columns, *[(F.lit(1.0) + sum((F.when(F.contains("lower", F.lit(k)), T.substring_count(F.col("lower"), k)).otherwise(0) for k in ks), F.lit(0))).alias(f"genre_{i}") for i, ks in enumerate(keywords.values())])
    return counted.select(*rows.columns, normalised([F.col(f"genre_{i}") for i in range(len(keywords))], tuple(keywords)).alias("genres"))


def filled(given: Column) -> Column:
    """A provider's map of scores -> genres: known names with positive scores, the rest at a floor."""
    return normalised([F.when(F.coalesce(F.try_element_at(given, F.lit(g)), F.lit(0.0)) > 0, F.try_element_at(given, F.lit(g))).otherwise(F.lit(LEAST)) for g in ORDER])


def rolled_up(chaps: DataFrame) -> DataFrame:
    """Chapters with genres -> doc_id, genre, score, rank over the whole manuscript."""
    tall = chaps.select("doc_id", F.explode_outer("genres").alias("g")).groupBy("doc_id", F.col("g.name").alias("genre")).agg(F.sum("g.score").alias("total"))
    tall = tall.withColumn("score", F.col("total") / F.sum("total").over(Window.partitionBy("doc_id")))
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("genre"))
    return tall.select("doc_id", "genre", "score", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.round("score", 9).desc(), place)).alias("rank"))


def percent(x: Column) -> Column:
    """x in 0 ... 1 with two decimals, rounded by the exact value of the double, ties to even."""
    exact = (x * float(1 << 60)).cast("bigint").cast("decimal(20,0)") * 200
    k = F.floor(exact / F.lit(2 << 60)).cast("decimal(3,0)")
    half = (k * 2 + 1) * F.lit(1 << 60)
    return F.format_string("%.2f", ((k + F.when((exact > half) | ((exact == half) & (k % 2 == 1)), 1).otherwise(0)) / 100).cast("double"))


def reason(genres: Column, chapter: Column) -> Column:
    return F.format_string("Heuristic fallback for chapter %d (top genre=%s %s).", chapter, genres[0]["name"], percent(genres[0]["score"]))


def decided(chaps: DataFrame, answers: DataFrame, provider: str = "provider") -> DataFrame:
    """Scored chapters + provider and reasoning, with a model's genres where it gave any.

    answers(doc_id, chapter, answer, error): answer is a JSON object with genre_scores and reasoning; without one, or with no
    score above zero, the keywords' genres stand, and the reason says what failed.
    """
    given = F.from_json("answer", "genre_scores map<string,double>, reasoning string")
    told = answers.select("doc_id", "chapter", given.alias("a"), "error")
    told = told.select("doc_id", "chapter", F.col("a.genre_scores").alias("_given"), F.col("a.reasoning").alias("_told"), F.col("error").alias("_error"))
    rows = chaps.join(told, ["doc_id", "chapter"], "left")
    some = F.coalesce(F.exists(F.array(*map(F.lit, ORDER)), lambda g: F.coalesce(F.try_element_at("_given", g), F.lit(0.0)) > 0), F.lit(False))
    genres = F.when(some, filled(F.col("_given"))).otherwise(F.col("genres"))
    failed = F.when(F.col("_error").isNotNull(), F.concat(F.lit(" Provider unavailable: "), "_error")).otherwise("")
    own = F.when(F.coalesce(T.trimmed(F.col("_told")), F.lit("")) != "", T.trimmed(F.col("_told"))).otherwise(F.concat(F.lit("Model classification favored "), genres[0]["name"], F.lit(" from sampled chapter windows.")))
    why = F.when(some, own).otherwise(F.concat(reason(F.col("genres"), F.col("chapter")), failed))
    return rows.select(*[c for c in chaps.columns if c != "genres"], genres.alias("genres"), F.when(some, provider).otherwise("heuristic").alias("provider"), why.alias("reasoning"))


def reasons(chaps: DataFrame, size: int = REASON_BYTES) -> DataFrame:
    """doc_id, reasoning: the chapters' reasons in order, cut to `size` bytes."""
    line = F.col("reasoning") if "reasoning" in chaps.columns else reason(F.col("genres"), F.col("chapter"))
    lines = chaps.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chapter", line.alias("line")))).alias("x"))
    return lines.select("doc_id", F.decode(F.substring(F.encode(F.array_join("x.line", "\n"), "UTF-8"), 1, size), "UTF-8").alias("reasoning"))


def dominant(providers: DataFrame) -> DataFrame:
    """(doc_id, provider) -> the most frequent provider, the first by name of equals; none: heuristic."""
    counts = providers.where("provider IS NOT NULL").groupBy("doc_id", "provider").count()
    best = counts.groupBy("doc_id").agg(F.min_by("provider", F.struct(-F.col("count"), "provider")).alias("provider"))
    return providers.select("doc_id").distinct().join(best, "doc_id", "left").fillna("heuristic", ["provider"])


def tall(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode_outer("genres").alias("rank", "g")).select(*keys, (F.col("rank") + 1).alias("rank"), F.col("g.name").alias("genre"), F.round("g.score", 6).alias("score"))


def genre_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tall(scores(docs(spark, sf_dir)), "doc_id")


def genre_scores_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tall(scores(docs(spark, sf_dir), FREQUENT), "doc_id")


def genre_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolled_up(scores(turns(spark, sf_dir), FREQUENT)).withColumn("score", F.round("score", 6))


def genre_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(scores(turns(spark, sf_dir), FREQUENT))


def genre_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return dominant(rows.select(F.col("conv_id").alias("doc_id"), F.when(F.col("turn") % 4 != 3, F.col("role")).alias("provider")))


def _sql_scores(source: str, keywords, keys: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {keys}, {i} AS place, '{g}' AS genre, (1 + {_count('lower(text)', ks)})::DOUBLE AS v FROM {source}" for i, (g, ks) in enumerate(keywords.items()))
    return f"SELECT {keys}, genre, place, v / sum(v) OVER (PARTITION BY {keys}) AS score, row_number() OVER (PARTITION BY {keys} ORDER BY v DESC, place)::INT AS rank FROM ({parts})"


_ROLL = f"WITH c AS ({_sql_scores(TURNS, FREQUENT, 'doc_id, chapter')})"
QUERIES = {"genre_scores": genre_scores, "genre_scores_frequent": genre_scores_frequent, "genre_rollup": genre_rollup, "genre_reasons": genre_reasons, "genre_providers": genre_providers}
ORACLES = {
    "genre_scores": f"SELECT doc_id, rank, genre, round(score, 6) AS score FROM ({_sql_scores(_D, KEYWORDS, 'doc_id')})",
    "genre_scores_frequent": f"SELECT doc_id, rank, genre, round(score, 6) AS score FROM ({_sql_scores(_D, FREQUENT, 'doc_id')})",
    "genre_rollup": _ROLL + ", t AS (SELECT doc_id, genre, min(place) AS place, sum(score) AS total FROM c GROUP BY doc_id, genre), r AS (SELECT doc_id, genre, place, total / sum(total) OVER (PARTITION BY doc_id) AS score FROM t) SELECT doc_id, genre, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, place)::INT AS rank FROM r",
    "genre_reasons": _ROLL + " SELECT doc_id, substr(string_agg(format('Heuristic fallback for chapter {} (top genre={} {:.2f}).', chapter, genre, score), chr(10) ORDER BY chapter), 1, 2400) AS reasoning FROM c WHERE rank = 1 GROUP BY doc_id",
    "genre_providers": "WITH p AS (SELECT conv_id AS doc_id, CASE WHEN turn % 4 <> 3 THEN role END AS provider FROM conversations), n AS (SELECT doc_id, provider, count(*) AS n FROM p WHERE provider IS NOT NULL GROUP BY ALL), b AS (SELECT doc_id, (array_agg(provider ORDER BY n DESC, provider))[1] AS provider FROM n GROUP BY doc_id) SELECT DISTINCT p.doc_id, coalesce(b.provider, 'heuristic') AS provider FROM p LEFT JOIN b USING (doc_id)",
}
