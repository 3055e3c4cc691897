"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a 64-bit ring; a document belongs to the first point clockwise of its key's hash. A shard
takes rows up to its bound; rows that find it full go on clockwise to the next point whose shard has room. The bounds add up
to the number of rows (two neighbouring sizes), so counts differ by one at most: the law is `rows`.

Only counts per piece of an arc (shards x vnodes x pieces rows, whatever the input) reach the driver, which lays out how many rows
of an arc go where. Rows need one shuffle, without texts if the caller has not selected them, to be ranked in their piece.

Defined cases: null text: size 16 and crc of no bytes; null doc_id: hashed like any other key; repeated rows: ranked next to
each other, each with a slot of its own; very long texts: as any other; empty table: no rows. Further columns are carried; what
`assign` makes (size, text_crc32, shard, slot) takes the place of columns of these names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_or_empty

#: Pieces of an arc; counts of (arc, piece) on the driver are SHARDS x VNODES x PIECES at most.
SHARDS, VNODES, PIECES, SEED = 40, 64, 16, "ring"


def ring(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard), in ring order."""
    points = spark.range(shards * vnodes).select(F.xxhash64(F.lit(SEED), F.lit("node"), "id").alias("p"), (F.col("id") % shards).cast("int").alias("s"))
    return sorted((r.p, r.s) for r in points.collect())


def layout(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, slot of the first) for each run of rows that stay together.

    First each shard fills up from its own arcs, in ring order; then what is left over walks clockwise, in ring order.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, runs, left = [0] * shards, [], []

    def put(arc: int, start: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n > 0:
            runs.append((arc, start, start + n, shard, used[shard]))
            used[shard] += n
        return n

    for arc, shard in enumerate(owners):
        n = counts.get(arc, 0)
        took = put(arc, 0, n, shard)
        if took < n:
            left.append((arc, took, n - took))
    for arc, start, n in left:
        at = arc
        while n:
            at = (at + 1) % len(owners)
            took = put(arc, start, n, owners[at])
            start, n = start + took, n - took
    return runs


OWN = ("size", "text_crc32", "shard", "slot")


def assign(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, digests: tuple[Column, Column] | None = None) -> DataFrame:
    """docs + size, text_crc32, shard, slot. digests: size and crc, if they are known already and docs has no text.

    Rows are ranked by hash in pieces of their arc: an arc that holds much of the data, as by one repeated doc_id, is many tasks.
    Counts are taken at once (a job), the rest is lazy.
    """
    spark = docs.sparkSession
    nodes = ring(spark, shards, vnodes)
    points, owners = np.array([p for p, _ in nodes], dtype=np.int64), [s for _, s in nodes]

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, h.to_numpy()) % len(points)).astype(np.int32))

    size, crc = digests or (octets(), checksum())
    keyed = docs.withColumn("_ring_size", size).withColumn("_ring_crc", crc).withColumn("_ring_hash", F.xxhash64(F.lit(SEED), F.lit("key"), "doc_id"))
    piece = F.pmod(F.xxhash64("doc_id", "_ring_crc", "_ring_size"), F.lit(PIECES)).cast("int")
    keyed = keyed.withColumn("_ring_arc", arc_of("_ring_hash")).withColumn("_ring_piece", piece)
    sums = sorted((r.a, r.p, r.n) for r in keyed.groupBy(F.col("_ring_arc").alias("a"), F.col("_ring_piece").alias("p")).agg(F.count("*").alias("n")).collect())
    counts, before = {}, []
    for arc, part, n in sums:
        before.append((arc, part, counts.get(arc, 0)))
        counts[arc] = counts.get(arc, 0) + n
    plan = spark.createDataFrame(layout(counts, owners, shards) or [(-1, 0, 0, 0, 0)], "_ring_arc int, _ring_from long, _ring_to long, _ring_shard int, _ring_slot long")
    bases = spark.createDataFrame(before or [(-1, 0, 0)], "_ring_arc int, _ring_piece int, _ring_base long")
    within = Window.partitionBy("_ring_arc", "_ring_piece").orderBy("_ring_hash", "doc_id", "_ring_crc", "_ring_size")
    ranked = keyed.withColumn("_ring_rank", F.row_number().over(within) - 1).join(F.broadcast(bases), ["_ring_arc", "_ring_piece"])
    ranked = ranked.withColumn("_ring_rank", F.col("_ring_rank") + F.col("_ring_base"))
    joined = ranked.alias("r").join(F.broadcast(plan).alias("p"), F.expr("r._ring_arc = p._ring_arc AND _ring_rank >= _ring_from AND _ring_rank < _ring_to"))
    slot = F.col("_ring_slot") + F.col("_ring_rank") - F.col("_ring_from")
    kept = [c for c in docs.columns if c not in OWN]
    return joined.select(*[F.col(f"r.`{c}`") for c in kept], F.col("_ring_size").alias("size"), F.col("_ring_crc").alias("text_crc32"), F.col("_ring_shard").alias("shard"), slot.alias("slot"))


def octets() -> Column:
    return (F.octet_length(text_or_empty()) + 16).cast("long")


def checksum() -> Column:
    return F.crc32(F.encode(text_or_empty(), "UTF-8"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, vnodes: int = VNODES) -> None:
    """The shards as folders shard=0 ... of Parquet files, rows in slot order."""
    assign(docs, shards, vnodes).repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", octets().alias("size"), checksum().alias("text_crc32"))
    return assign(docs, digests=(F.col("size"), F.col("text_crc32"))).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
ORACLES: dict[str, str] = {}
