"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking.

The index is fitted on a bounded sample (`FIT_ROWS` vectors, smallest hash first): coarse centroids by k-means, about half the
square root of the entries (in two levels when they are many, `MAX_LISTS` at most), then for each of `PARTS` slices of the residual
a codebook. Every vector is assigned to its centroid's list and coded. Equal vectors share one entry with their `k + 1` smallest
ids: more can never be among a query's k nearest, for ties go to the smaller id.

A query looks at every list that can hold one of its k nearest: these lie no farther than the k nearest of the sample, and a vector
of a list no nearer than the plane between that list's centroid and the query's own. These are few where vectors form clusters, most where
they do not. Lists are cut into blocks of about `BLOCK` entries by hash, so a list that
holds much of the data is many tasks; queries are dealt to the blocks of their lists. In a block a query's table of distances to
all codewords gives approximate distances of all entries; the `RERANK` best are measured exactly on their original vectors, as is
every other entry that its code's own error lets be nearer than those, and the k nearest leave the block. So nothing that is among a query's k nearest is passed over. The k nearest of all blocks are the answer.

The table that takes part, its sample and its coded entries are made at once (jobs), the search itself is lazy.

Defined cases: vectors that are null, zero, or have null or non-finite components take no part, nor do null ids; vectors whose
length is not the usual (most frequent) one neither; fewer than k candidates: all of them; repeated rows of one id count once
per distinct vector; an empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, written

FIT_ROWS, MAX_LISTS, FLAT, PARTS, CODEWORDS, RERANK, BLOCK, EVERY, K = 20_000, 2048, 256, 16, 64, 100, 4096, 100, 10
TUNED, TARGET = 200, 0.97
#: Share of a distance by which rounding may put a bound off, and queries that are held against the sample at once.
SLACK, ASKED = 1e-6, 256
RESULT = "query_id long, vec_id long, score double"


def lists_for(entries: int) -> int:
    return int(min(MAX_LISTS, max(8, round(entries**0.5 / 2))))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds from a seeded choice of rows; an empty cluster takes the row that lies worst."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        distance = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
        near = distance.argmin(1)
        for c in range(k):
            own = x[near == c]
            centres[c] = own.mean(0) if len(own) else x[distance.min(1).argmax()]
    return centres


class Index:
    """Coarse centroids and codebooks; small, and sent to the tasks as part of their function."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, codewords: int):
        self.centres = kmeans(sample, lists if lists <= FLAT else round(lists**0.5))
        if lists > FLAT:
            near, n = self.nearest(sample, 1)[:, 0], len(sample)
            self.centres = np.concatenate([kmeans(own, max(1, round(lists * len(own) / n))) for c in range(len(self.centres)) if len(own := sample[near == c])])
        width = sample.shape[1]
        self.cuts = np.linspace(0, width, min(parts, width) + 1).astype(int)
        rest = sample - self.centres[self.nearest(sample, 1)[:, 0]]
        self.books = [kmeans(rest[:, a:b], codewords) for a, b in zip(self.cuts, self.cuts[1:])]

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        distance = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        return np.argsort(distance, axis=1, kind="stable")[:, :n]

    def probes(self, sample: np.ndarray, k: int, target: float) -> int:
        """Lists to look at, in order of distance, for `target` of the k nearest within the sample."""
        asked = sample[: min(TUNED, len(sample))]
        distance = (sample**2).sum(1) - 2 * asked @ sample.T
        distance[np.arange(len(asked)), np.arange(len(asked))] = np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.centres)
        lists = self.nearest(sample, 1)[:, 0][np.argpartition(distance, k - 1, axis=1)[:, :k]]
        place = np.argsort(self.nearest(asked, len(self.centres)), axis=1)
        return int(np.ceil(np.quantile(np.take_along_axis(place, lists, axis=1), target))) + 1

    def reachable(self, x: np.ndarray, sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of every list that can hold one of a query's k nearest; the query itself may be in the sample."""
        between = np.sqrt(np.maximum(0.0, (self.centres**2).sum(1)[:, None] - 2 * self.centres @ self.centres.T + (self.centres**2).sum(1)))
        who, which = [], []
        for i in range(0, len(x), ASKED):
            q = x[i : i + ASKED]
            size = (q**2).sum(1)[:, None]
            scale = size + max((sample**2).sum(1).max(), (self.centres**2).sum(1).max())
            far = np.sqrt(np.partition(np.maximum(0.0, size - 2 * q @ sample.T + (sample**2).sum(1)), k, axis=1)[:, k : k + 1] + SLACK * scale) if len(sample) > k else np.full((len(q), 1), np.inf)
            d = size - 2 * q @ self.centres.T + (self.centres**2).sum(1)
            own = d.argmin(1)
            apart = between[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                bound = np.where(apart > 0, (d - d[np.arange(len(q)), own][:, None] - SLACK * scale) / (2 * apart), -np.inf)
            a, b = np.nonzero(bound <= far)
            who.append(a + i)
            which.append(b)
        return np.concatenate(who), np.concatenate(which)

    def errors(self, x: np.ndarray, codes: np.ndarray, which: int) -> np.ndarray:
        """How far each vector of a list lies from what its code stands for."""
        rest = x - self.centres[which]
        return np.sqrt(sum(((rest[:, a:z] - b[codes[:, i]]) ** 2).sum(1) for i, (b, a, z) in enumerate(zip(self.books, self.cuts, self.cuts[1:]))))

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centres[lists]
        slices = [rest[:, a:b] for a, b in zip(self.cuts, self.cuts[1:])]
        return np.stack([((b**2).sum(1) - 2 * s @ b.T).argmin(1) for s, b in zip(slices, self.books)], axis=1).astype(np.uint8)

    def tables(self, query: np.ndarray, which: int) -> list[np.ndarray]:
        """Squared distances of the query's residual to every codeword, slice by slice."""
        rest = query - self.centres[which]
        return [((b - rest[a:z]) ** 2).sum(1) for b, a, z in zip(self.books, self.cuts, self.cuts[1:])]


def vectors(table: DataFrame) -> DataFrame:
    """The rows that take part: vec_id, v (array of float, or of double for other kinds)."""
    kind = dict(table.dtypes)["embedding"]
    kind = kind if kind == "array<float>" else "array<double>"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    return rows.where(fine)


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.stack(list(column)).astype(np.float64)


def search(table: DataFrame, every: int = EVERY, k: int = K, lists: int | None = None, probes: int | None = None, rerank: int = RERANK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for each query: the rows whose vec_id is divisible by `every`.

    lists follow the table unless they are given; with probes (Index.probes() tells how many hold a share of the nearest), a query looks at that many lists and may miss some of its nearest.
    """
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors(table)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return empty
    rows = written(rows.where(F.size("v") == usual["n"]))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toPandas()
    sample = np.random.default_rng(0).permutation(np.unique(_matrix(sample["v"]), axis=0))  # copies say nothing about how the others lie
    index = Index(sample, lists or lists_for(rows.count()), PARTS, CODEWORDS)
    kind = dict(rows.dtypes)["v"]

    # equal vectors: one entry, with the smallest ids (the limit is pushed below the shuffle)
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                near = index.nearest(x, 1)[:, 0]
                codes = [c.tobytes() for c in index.codes(x, near)]
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(codes, pa.binary()), batch.column("v"), batch.column("ids")], names=["list", "code", "v", "ids"])

    coded = written(entries.mapInArrow(assigned, f"list int, code binary, v {kind}, ids array<long>"))
    sizes = coded.groupBy("list").count().withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")  # a row per list, MAX_LISTS at most
    blocked = coded.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int")).drop("blocks")

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                if probes:
                    near = index.nearest(x, probes)
                    who, near = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
                else:
                    who, near = index.reachable(x, sample, k)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column("vec_id").take(pa.array(who)), batch.column("v").take(pa.array(who))], names=["list", "query_id", "v"])

    queries = rows.where(F.col("vec_id") % every == 0).distinct().mapInArrow(probed, f"list int, query_id long, v {kind}")
    queries = queries.join(F.broadcast(sizes), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def compared(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(entries) and len(asked):
            x, codes, which = _matrix(entries["v"]), np.stack([np.frombuffer(c, np.uint8) for c in entries["code"]]), int(entries["list"].iloc[0])
            ids, error = entries["ids"].tolist(), index.errors(x, codes, which)
            for query_id, v in zip(asked["query_id"], asked["v"]):
                q = np.asarray(v, dtype=np.float64)
                rough = sum(t[codes[:, i]] for i, t in enumerate(index.tables(q, which)))
                best = np.argpartition(rough, rerank - 1)[:rerank] if len(rough) > rerank else np.arange(len(rough))
                exact = np.sqrt(((x[best] - q) ** 2).sum(1))
                if len(rough) > len(best):
                    last = np.partition(exact, k)[k] if len(exact) > k else np.inf
                    nearest = np.sqrt(np.maximum(0.0, rough))
                    more = nearest - error <= last + SLACK * (nearest + error + last)
                    more[best] = False
                    best = np.append(best, np.flatnonzero(more))
                    exact = np.sqrt(((x[best] - q) ** 2).sum(1))
                pairs = [(s, i) for s, b in sorted(zip(exact.tolist(), best.tolist()))[: k + 1] for i in ids[b] if i != query_id]
                # an entry may lend all its ids; entries tied with the last one are all looked at
                last = sorted(exact)[min(k, len(exact) - 1)]
                pairs += [(s, i) for s, b in zip(exact.tolist(), best.tolist()) if s == last for i in ids[b] if i != query_id]
                found += [(query_id, i, s) for s, i in sorted(set(pairs))[:k]]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["list", "block"]
    spread = partitions(spark)
    near = blocked.repartition(spread, *keys).groupBy(*keys).cogroup(queries.repartition(spread, *keys).groupBy(*keys)).applyInPandas(compared, RESULT)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op9_ann": op9_ann}
ORACLES: dict[str, str] = {}
