"""Importance resampling towards a target: hashed n-gram features, weights by the target's against the corpus's share of each bucket.

A slice of a partition's texts is one sequence of word ids. Its suffix array, sorted by as many words as the longest n-gram has,
puts equal n-grams next to each other: a run of suffixes that share n words (by the LCP of neighbours) is one n-gram with all
its places. Each run is hashed once; its bucket id is scattered back to the run's places, so a document's features are an array of bucket ids
in the order of its words.

1. features() writes doc_id, counts and bucket ids, about two bytes a word; texts are read once.
2. Buckets are counted over all documents and over the target's texts, in each task first; a table of `buckets` rows, whatever
   the corpus's size, holds the gains.
3. A document's weight is the floored mean of its features' gains; Gumbel noise from a hash of the doc_id makes the highest scores a
   weighted draw without replacement, which reruns repeat.
4. Ranks come from counts by score (a score is an integer of a bounded range, so these are few, whatever the corpus's size) and an
   order by doc_id within one score.

features() and scored() are jobs at once, ranks are lazy.

Defined cases: null or empty text: no words, no features, weight 0, never drawn; null doc_id: its noise is that of `<seed>:` alone,
first among ties; ties: by doc_id, then by the row's other values; repeated rows: a row each, with ranks that follow each other; very long
texts: a slice of their own; empty table: no rows; empty target: every bucket counts 0 there; `drawn` carries further columns, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, text_or_empty, tidy, written
from .spans import WORD_BYTES, column, flat, runs
from .tokens import slices

#: n-grams of LOW to HIGH words; the query's features are single words.
LOW, HIGH, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 1, 10_000, 2024, 10, 20
SLICE, BROADCAST_SCORES = 8 << 20, 500_000


def suffixes(codes: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array by the first `depth` words, words that each suffix shares with the one before it in that order).

    left: words from each place to the end of its text, which no suffix reaches over.
    """
    rank, step, places = codes.astype(np.int64), 1, np.arange(len(codes))
    while step < depth:
        more = min(step, depth - step)
        after = np.where(left > more, rank[np.minimum(places + more, len(codes) - 1)], -1)
        rank = np.unique(rank * (after.max(initial=0) + 2) + after + 1, return_inverse=True)[1]
        step += more
    order = np.argsort(rank, kind="stable")
    shared, same = np.zeros(len(order), dtype=np.int64), np.ones(max(len(order) - 1, 0), dtype=bool)
    for j in range(depth):
        a, b = order[1:], order[:-1]
        inside = (left[a] > j) & (left[b] > j)
        same &= inside & (codes[np.minimum(a + j, len(codes) - 1)] == codes[np.minimum(b + j, len(codes) - 1)])
        shared[1:] += same
    return order, shared


def bucket_ids(data: np.ndarray, offsets: np.ndarray, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowered texts -> (words of each, bucket ids of all features by text and n, features of each text)."""
    member = WORD_BYTES[data]
    starts, ends = runs(member, offsets)
    coded = column(data, member, starts, ends).dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    left = np.repeat(first[1:], n_words) - np.arange(len(codes))
    order, shared = suffixes(codes, left, high)
    text = np.repeat(np.arange(len(n_words)), n_words)
    crcs = np.fromiter(map(zlib.crc32, names), dtype=np.int64, count=len(names))
    found, owner = [], []
    for n in range(low, high + 1):
        able = left[order] >= n  # a suffix that is too short never stands between two equal n-grams
        at, new = order[able], shared[able] < n
        heads = at[new]
        if n == 1:
            values = crcs[codes[heads]]
        else:
            values = np.fromiter((_crc(names, crcs, codes[p : p + n]) for p in heads.tolist()), dtype=np.int64, count=len(heads))
        scattered = np.zeros(len(codes), dtype=np.int64)
        scattered[at] = (values % buckets)[np.cumsum(new) - 1]
        whole = left >= n
        found.append(scattered[whole])
        owner.append(text[whole])
    owners = np.concatenate(owner)
    values = np.concatenate(found)
    if low != high:
        values = values[np.argsort(owners, kind="stable")]
    return n_words, values, np.bincount(owners, minlength=len(n_words))


def _crc(names: list[bytes], crcs: np.ndarray, codes: np.ndarray) -> int:
    value = int(crcs[codes[0]])
    for c in codes[1:].tolist():
        value = zlib.crc32(names[c], zlib.crc32(b" ", value))
    return value


def features(docs: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_key, n_words, n_features, features (bucket ids, little-endian, two bytes each up to 65,536 buckets, else four)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, size=SLICE):
                n_words, values, sizes = bucket_ids(*flat(some.column("text")), low, high, buckets)
                ends = np.concatenate([[0], np.cumsum(sizes)]) * np.dtype(kind).itemsize
                raw = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values.astype(kind))])
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), some.column("text_key"), pa.array(n_words), pa.array(sizes), raw.cast(pa.binary())], names=["doc_id", "text_key", "n_words", "n_features", "features"])
        tidy()

    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"), "text")
    return rows.mapInArrow(task, "doc_id long, text_key long, n_words long, n_features long, features binary")


def _values(raw: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all bucket ids of a column, where each row's begin)."""
    data, offsets = flat_binary(raw)
    return data.view(kind), offsets // np.dtype(kind).itemsize


def flat_binary(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    whole = raw.cast(pa.large_binary())
    _, ends, data = whole.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(bytes(memoryview(data)[offsets[0] : offsets[-1]]) if data is not None else b"", dtype=np.uint8), offsets - offsets[0]


def counted(found: DataFrame, buckets: int) -> DataFrame:
    """features() rows -> (bucket, n): each task counts first."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_values(batch.column("features"), kind)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return found.select("features").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of corpus and target -> (bucket, gain) for all buckets: floored thousandths of the logarithm of the ratio of smoothed shares."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    sums = both.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    totals = sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return sums.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def noise(seed: int = SEED) -> Column:
    """Floored thousandths of a Gumbel variable, by a hash of the doc_id."""
    shown = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(shown, 1, 8), 16, 10).cast("double")
    return F.floor(-F.log(-F.log((h + 0.5) / 4294967296.0)) * 1000)


def scored(docs: DataFrame, target: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, text_key, n_words, n_features, weight, score (written)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    found = written(features(docs, low, high, buckets))
    aim = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), low, high, buckets)
    table = gains(counted(found, buckets), counted(aim, buckets), buckets).collect()  # `buckets` rows
    gain = np.zeros(buckets, dtype=np.int64)
    gain[[r["bucket"] for r in table]] = [r["gain"] for r in table]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, offsets = _values(batch.column("features"), kind)
                sums = np.concatenate([[0], np.cumsum(gain[values])])
                sizes = np.diff(offsets)
                weights = (sums[offsets[1:]] - sums[offsets[:-1]]) // np.maximum(sizes, 1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "n_words", "n_features")), pa.array(weights)], names=["doc_id", "text_key", "n_words", "n_features", "weight"])

    weighed = found.mapInArrow(task, "doc_id long, text_key long, n_words long, n_features long, weight long")
    rows = written(weighed.withColumn("score", F.col("weight") + noise(seed)))
    discard(found)
    return rows


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored() rows + rank: 1, 2, 3 ... of the highest scores of documents with least_words words or more, as many as percent of these; else null."""
    able = F.col("n_words") >= least_words
    counts = written(rows.where(able).groupBy("score").agg(F.count("*").alias("n")))  # a row for each integer of the scores' range at most
    limit = percent * (counts.agg(F.sum("n")).first()[0] or 0) // 100
    above = F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")
    bases = counts.select("score", above.alias("above")).where(F.col("above") < limit)
    bases = F.broadcast(bases) if counts.count() <= BROADCAST_SCORES else bases
    met = rows.withColumn("_able", able).join(bases, "score", "left").withColumn("_in", F.col("_able") & F.col("above").isNotNull())
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "text_key")
    inside = met.where("_in").withColumn("rank", (F.col("above") + F.row_number().over(order)).cast("long"))
    inside = inside.withColumn("rank", F.when(F.col("rank") <= limit, F.col("rank")))
    outside = met.where("NOT _in").withColumn("rank", F.lit(None).cast("long"))
    return inside.unionByName(outside).select(*rows.columns, "rank")


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **features: int) -> DataFrame:
    """The documents that are drawn; a row repeated with doc_id and text is drawn with all its copies if one of them is."""
    rows = ranked(scored(docs, target, **features), percent, least_words).where("rank IS NOT NULL")
    keys = written(rows.select(F.col("doc_id").alias("_drawn_id"), F.col("text_key").alias("_drawn_key")).distinct())
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_SCORES else keys
    met = docs.withColumn("_own_key", F.xxhash64(text_or_empty())).join(keys, F.col("doc_id").eqNullSafe(F.col("_drawn_id")) & (F.col("_own_key") == F.col("_drawn_key")), "left_semi")
    return met.select(*docs.columns)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return ranked(rows).select("doc_id", "n_features", "weight", "score", "rank")


def crc32_sql(text: str) -> str:
    """DuckDB: unsigned crc32 of a text's UTF-8 bytes, beside column t of CRC_TABLE_SQL."""
    digit = "strpos('0123456789ABCDEF', substr(hex(encode({0})), {1}::INT, 1)) - 1"
    steps = f"list_transform(range(0, octet_length(encode({text}))), lambda i: 16 * ({digit.format(text, '(2 * i + 1)')}) + {digit.format(text, '(2 * i + 2)')})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


#: The polynomial's step for each of 256 bytes, as a table of one row.
CRC_TABLE_SQL = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"

QUERIES = {"op12_resampling": op12_resampling}
ORACLES = {
    "op12_resampling": f"""
WITH {CRC_TABLE_SQL},
low AS (SELECT 'd' AS side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'b', NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM low),
counts AS (SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
named AS (SELECT word, {crc32_sql("word")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM counts), crc),
sums AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM counts JOIN named USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (coalesce(sum(s) OVER (), 0)::DOUBLE + {BUCKETS}) / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce(sum(t) OVER (), 0)::DOUBLE + {BUCKETS}))))::BIGINT AS gain FROM sums),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM counts JOIN named USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scores AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scores WHERE n_features >= {LEAST_WORDS})
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank FROM scores s LEFT JOIN able a ON s.doc_id = a.doc_id"""
}
