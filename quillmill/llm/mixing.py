"""Mixing sources to target weights by weighted fair queueing (native: DataFrame functions only).

Each source's documents are put in a seeded random order and lie end to end on the source's own line of words, up to
`max_epochs` rounds of it. A document copy's virtual finish time is the source's words up to its end divided by the source's
target. Serving copies by finish time keeps every source at its share, and the total budget is used up exactly at virtual time
1, for the targets add up to the budget: copies that end by then are whole, the one in service is cut at its share.

No source is a task of its own. A source's line is cut into `2 ** bucket_bits` buckets by hash, sums per (source, bucket) are
pre-aggregated, and only these small sums are put in order per source; rows are ordered per (source, bucket).

`targets` puts a row per source in order in one task: sources are few against documents, and a row is three numbers. All is lazy but
the table of sizes that op7 writes first.

Defined cases: null source: a source of its own, last in order; null or empty text: size 0, never taken; empty table: no rows;
rows with the same doc_id are rows of their own, in order of size; very long texts: as any other, cut by words where the budget
ends. Further columns are carried: `schedule` puts its own in the place of columns of the same names, `mixture` keeps those of the
documents and then leaves out its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, n_words, written

SHARE, MAX_EPOCHS, WEIGHTS, BUCKET_BITS = 1.5, 2, (3, 1, 2), 12


def source_key(column: str = "source") -> Column:
    """Text order of this key is the source order by code point, null last."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(skey, source_size) -> (skey, source_size, target): the capped shares of the budget.

    Water level in one ordered pass: with sources in order of cap per weight, the capped ones are the first few, and the level
    is what they leave of the budget over the weights of the others. Rows are as many as sources.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy("skey")
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    ratio = F.col("cap") / F.col("weight")
    everything = Window.partitionBy()
    ordered = Window.orderBy(ratio, "skey")
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing)))
    )
    level = (F.col("budget") - F.col("caps_before")) / F.col("weights_left")
    ranked = ranked.withColumn("level", F.when(level <= ratio, level)).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return ranked.select("skey", "source_size", target.alias("target"))


OWN = ("size", "source_size", "target", "begin", "taken", "finish")


def schedule(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = "mix", bucket_bits: int = BUCKET_BITS, size: Column | None = None) -> DataFrame:
    """docs + OWN: size, source_size, target, begin (words of its source before it), taken, finish (its first copy's virtual finish time).

    size: the words of a row, if they are known already.
    """
    plan = _plan(docs, weights, share, max_epochs, seed, bucket_bits, size)
    return plan.select(*[c for c in docs.columns if c not in OWN], *[F.col(f"_mix_{c}").alias(c) for c in OWN])


def _plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = "mix", bucket_bits: int = BUCKET_BITS, size: Column | None = None) -> DataFrame:
    """docs + OWN with _mix_ before each name."""
    sized = docs.withColumn("_mix_size", n_words() if size is None else size).withColumn("_mix_skey", source_key())
    sized = sized.withColumn("_mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    sized = sized.withColumn("_mix_bucket", F.conv(F.substring("_mix_key", 1, 8), 16, 10).cast("long").bitwiseAND((1 << bucket_bits) - 1))
    sums = sized.groupBy(F.col("_mix_skey").alias("skey"), F.col("_mix_bucket").alias("bucket")).agg(F.sum("_mix_size").alias("bucket_size"))
    per_source = sums.groupBy("skey").agg(F.sum("bucket_size").alias("source_size"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("base"))
    bases = bases.join(targets(per_source, weights, share, max_epochs), "skey")
    bases = bases.select(*[F.col(c).alias(f"_mix_{c}") for c in ("skey", "bucket", "base", "source_size", "target")])
    within = Window.partitionBy("_mix_skey", "_mix_bucket").orderBy("_mix_key", "doc_id", "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_mix_inner", F.coalesce(F.sum("_mix_size").over(within), F.lit(0))).join(bases, ["_mix_skey", "_mix_bucket"])
    begin = F.col("_mix_base") + F.col("_mix_inner")
    goal = F.floor(F.col("_mix_target"))
    per_epoch = [F.least(F.col("_mix_size"), F.greatest(F.lit(0).cast("long"), goal - F.col("_mix_source_size") * e - begin)) for e in range(max_epochs)]
    taken = per_epoch[0]
    for more in per_epoch[1:]:
        taken = taken + more
    finish = F.when(F.col("_mix_target") > 0, (begin + F.col("_mix_size")) / F.col("_mix_target"))
    made = [begin.alias("_mix_begin"), taken.cast("long").alias("_mix_taken"), finish.alias("_mix_finish")]
    return placed.select(*docs.columns, "_mix_size", "_mix_source_size", "_mix_target", *made)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself in service order: one row per copy taken (`copy` from 0, `words` of it), cut copies with cut texts.

    Columns are those of docs plus copy, words and finish; the order is by virtual finish time.
    """
    rows = _plan(docs, **options).where(F.col("_mix_taken") > 0)
    whole = F.col("_mix_size")
    copies = F.ceil(F.col("_mix_taken") / whole)
    rows = rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    rows = rows.withColumn("_mix_words", F.least(whole, F.col("_mix_taken") - F.col("_mix_copy") * whole))
    rows = rows.withColumn("_mix_finish", (F.col("_mix_begin") + F.col("_mix_copy") * F.col("_mix_source_size") + F.col("_mix_words")) / F.col("_mix_target"))
    ends = F.expr(r"aggregate(slice(transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 0), w -> length(w)), 1, cast(_mix_words as int)), 0L, (a, n) -> a + n)")
    lead = F.length(F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0))
    cut = F.when(F.col("_mix_words") < whole, F.substring(F.col("text"), F.lit(1), (lead + ends).cast("int"))).otherwise(F.col("text"))
    ordered = rows.withColumn("text", cut).orderBy("_mix_finish", "doc_id", "_mix_copy")
    return ordered.select(*docs.columns, *[F.col(f"_mix_{c}").alias(c) for c in ("copy", "words", "finish") if c not in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(documents(spark, sf_dir).select("doc_id", "source", n_words().alias("size")))  # texts are read once
    plan = schedule(docs, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "finish")
    return plan.orderBy("finish", "doc_id")


SQL = r"""
WITH sized AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5('mix:' || doc_id::VARCHAR) AS k FROM documents),
src AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY encode(skey)) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM src),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
             sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left FROM w),
l AS (SELECT *, max(CASE WHEN (budget - caps_before) / weights_left <= cap / weight THEN (budget - caps_before) / weights_left END) OVER () AS level FROM r),
t AS (SELECT skey, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM l),
p AS (SELECT doc_id, size, s.skey, coalesce(sum(size) OVER (PARTITION BY s.skey ORDER BY (('0x' || substr(k, 1, 8))::BIGINT) % 4096, k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS beg FROM sized s)
SELECT doc_id, size, source_size, target,
       (least(size, greatest(0, floor(target)::BIGINT - beg)) + least(size, greatest(0, floor(target)::BIGINT - source_size - beg)))::BIGINT AS taken,
       CASE WHEN target > 0 THEN (beg + size) / target END AS finish
FROM p JOIN t USING (skey)
"""
QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": SQL}
