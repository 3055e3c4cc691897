"""Quality rules with cross-document line frequency.

One pass over the texts counts words, symbols and repeats, and hashes each text's normalised lines (lower case, runs of white
space as one space). Lines are then counted by host: in how many distinct documents of the host a line stands. Copies must not
count, or a large group of near copies would make all its own lines frequent: lines above the limit over distinct texts are
counted again over groups of near copies (`near_dedup`, on the whole texts that hold such lines), so that no shared line decides
what a copy is. A line in more than `MIN_DOCUMENTS` documents of a host is
removed, however large the host is; a document that keeps fewer than `LEFT_WORDS` words, or less than `LEFT_SHARE`
of its words, is depleted and rejected.

The host of a document is its source. Counts are pre-aggregated; lines travel as (host, hash), once to be counted and once to
meet the frequent ones, which are few: a broadcast up to `BROADCAST_LINES` of them (16 MB), a shuffled join beyond.

Measures and frequent lines are made by jobs at once, the verdicts are lazy.

Defined cases: null or empty text: no words, fails the base rules; null source: a host of its own; repeated rows: a row each;
lines without a word: never counted or removed; very long texts: as any other; empty table: no rows; further columns are carried
by `clean`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_dedup
from .common import discard, documents, tidy, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_DOCUMENTS, LEFT_WORDS, LEFT_SHARE = 20, 10, 0.2
BROADCAST_LINES = 500_000
SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<int>"
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    size = len(number)
    if size == n:
        return 0
    if size < 2_000_000:
        windows = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]
    else:  # number the pairs first, so that no product leaves 64 bits
        pairs = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)[1]
        windows = pairs[:-1] * size + codes[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum())


def line_key(line: bytes) -> tuple[int, int]:
    """(hash of the normalised line, its words); ASCII capitals are lowered."""
    words = line.lower().split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63), len(words)


def measure(text: str | None) -> tuple:
    """A row of MEASURES; lines keep their order, lines without a word have hash 0 and no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = raw.split(b"\n")
    full = [x for x in lines if x.translate(_SPACES).strip()]
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    keys = [line_key(x) for x in lines]
    return len(words), len(text or "") - spaces, symbols, len(full) - len(set(full)), repeat_words(words), [h if n else 0 for h, n in keys], [n for _, n in keys]


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, host, text_key, MEASURES, without texts."""
    schema = "doc_id long, source string, text_key long, " + MEASURES

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words"]
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                columns = zip(*map(measure, some.column("text").to_pylist()))
                made = [pa.array(c, type=k) for c, k in zip(columns, kinds)]
                kept = [some.column("doc_id").cast(pa.int64()), some.column("source"), some.column("text_key")]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=["doc_id", "source", "text_key", *names])
        tidy()

    rows = docs.select("doc_id", "source", text_key().alias("text_key"), "text").mapInArrow(task, schema)
    return rows.withColumn("host", host()).drop("source")


def text_key():
    """What a text's lines are removed by: rows with one host and key lose the same lines."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def host():
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def frequent_lines(table: DataFrame, docs: DataFrame | None = None, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(host, hash) of the lines in more than min_documents distinct documents of their host; without `docs` every distinct text is one."""
    real = F.array_distinct(F.filter("line_hash", lambda h: h != 0))
    lines = table.select("host", "text_key", F.explode(real).alias("hash"))

    def above(rows: DataFrame) -> DataFrame:
        return rows.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > min_documents).select("host", "hash")

    # rows first, which are pre-aggregated; only lines above the limit by rows are then counted by distinct texts
    often = written(above(lines))
    n = often.count()
    held = written(lines.join(F.broadcast(often) if n <= BROADCAST_LINES else often, ["host", "hash"]).distinct())
    discard(often)
    suspects = written(above(held))
    if docs is None or not (n := suspects.count()):
        return suspects
    held = held.join(F.broadcast(suspects) if n <= BROADCAST_LINES else suspects, ["host", "hash"])
    originals = held.join(copies(table, held, docs), "text_key").select("host", "hash", "original").distinct()
    return above(originals)


def copies(table: DataFrame, held: DataFrame, docs: DataFrame) -> DataFrame:
    """(text_key, original) for the texts of `held`: near copies have one original, found on whole texts, whatever single lines they share."""
    keys = held.select("text_key").distinct()
    rows = written(table.join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.min("doc_id").alias("row_id")))
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_LINES else rows
    texts = docs.select("doc_id", "text", text_key().alias("text_key")).join(rows, "text_key").where(F.col("doc_id").eqNullSafe(F.col("row_id")))
    texts = texts.select(F.col("text_key").alias("doc_id"), "text")
    sets = written(near_dedup.sets(texts))
    groups = written(near_dedup.grouped(sets, texts, near_dedup.STAGE_PERCENT).select(F.col("doc_id").alias("text_key"), F.col("component_id").alias("original")).distinct())
    discard(sets)
    return groups


def lost_words(table: DataFrame, docs: DataFrame | None = None, **limits) -> DataFrame:
    """(host, text_key) -> lost (words in removed lines), lines (numbers of removed lines, from 0); only texts that lose any."""
    frequent = written(frequent_lines(table, docs, **limits))
    if frequent.count() <= BROADCAST_LINES:
        frequent = F.broadcast(frequent)
    zipped = F.arrays_zip("line_hash", "line_words")
    lines = table.select("host", "text_key", F.posexplode(zipped).alias("line", "x"))
    lines = lines.select("host", "text_key", "line", F.col("x.line_hash").alias("hash"), F.col("x.line_words").alias("words")).where("words > 0")
    lost = lines.join(frequent, ["host", "hash"]).select("host", "text_key", "line", "words").distinct()
    return lost.groupBy("host", "text_key").agg(F.sum("words").alias("lost"), F.collect_list("line").alias("lines"))


def verdicts(table: DataFrame, lost: DataFrame) -> DataFrame:
    """The measured rows + base_failed, left_words, kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    judged = table.drop("line_hash", "line_words").join(lost.drop("lines"), ["host", "text_key"], "left")
    judged = judged.withColumn("left_words", F.col("n_words") - F.coalesce("lost", F.lit(0))).withColumn("base_failed", failed)
    depleted = (F.col("left_words") < LEFT_WORDS) | (F.col("left_words") < F.col("n_words") * LEFT_SHARE)
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, without their removed lines; columns are those of docs, n_chars is renewed."""
    table = written(measured(docs))
    lost = written(lost_words(table, docs, **limits))
    judged = verdicts(table, lost)
    rejected = judged.where(~F.col("kept")).select("host", "text_key").distinct().withColumn("rejected", F.lit(True))
    marks = lost.select("host", "text_key", "lines").join(rejected, ["host", "text_key"], "full")
    marks = written(marks.select(*[F.col(c).alias(f"_quality_{c}") for c in ("host", "text_key", "lines", "rejected")]))
    discard(table)
    weight = marks.agg(F.count("*") + F.coalesce(F.sum(F.greatest(F.size("_quality_lines"), F.lit(0))), F.lit(0))).first()[0]
    if weight <= BROADCAST_LINES:  # else equal texts meet in one task, which adaptive execution splits
        marks = F.broadcast(marks)
    rows = docs.withColumn("_quality_host", host()).withColumn("_quality_text_key", text_key())
    rows = rows.join(marks, ["_quality_host", "_quality_text_key"], "left").where("_quality_rejected IS NULL")
    kept_lines = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_quality_lines", i))
    rows = rows.withColumn("text", F.when(F.col("_quality_lines").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    table = written(measured(docs))
    judged = verdicts(table, lost_words(table, docs))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
