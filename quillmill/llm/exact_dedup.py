"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every text, A-Z lowered, has a 64-bit hash and a SHA-256. Of the hash as many upper bits are the fingerprint as the number of
   rows takes, and `SLACK` more, so about one text in 2**SLACK shares its fingerprint with another by chance.
2. Senders (tasks over the small table of hashes) sort their fingerprints and send each owner of a range of the fingerprint space a
   packet: the distinct ones, as Golomb-coded differences (the divisor a power of two; quotients in unary and remainders are two
   streams, so that both decode as arrays). A fingerprint takes about SLACK + 2 bits and the logarithm of the number of senders.
3. Owners merge their packets and return a bitmap for each: which of its fingerprints another packet holds too. With those
   repeated in the packet itself they are the suspects.
4. The texts of suspects, and of no others, are grouped by their bytes, pre-aggregated before the shuffle: a group of copies sends
   a row from each task, however large it is. Groups of two rows or more are classes; their rows meet their class by SHA-256.

Senders hold `SENDER_ROWS` rows at most and owners about `OWNER_ROWS` fingerprints, whatever the table's size. Tables that are
broadcast are counted before; larger ones are joined by shuffle, where adaptive execution splits the key of a large class.

fingerprints() to bitmaps() are jobs at once, labels are lazy.

Defined cases: null is an empty text, and all empty texts are one class; null doc_id: a row like others, never the largest unless all
of its class are null; rows repeated with their doc_id: a row each, all kept or none (`deduplicate` lets one stay); very long texts:
as any other; empty table: no rows; `deduplicate` carries further columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, partitions, text_or_empty, tidy, written
from .spans import flat

SLACK, SENDER_ROWS, OWNER_ROWS = 10, 2_000_000, 1_000_000
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PACKET = "part int, chunk int, owner int, n int, shift int, code binary, again binary, counts binary, ids array<long>, shas binary"


def golomb_shift(n: int, space: int) -> int:
    """Bits of a remainder for n values below `space`: the divisor is near the mean difference times ln 2."""
    return max(0, int(np.floor(np.log2(max(1.0, space / max(n, 1) * np.log(2))))))


def golomb_encode(values: np.ndarray, shift: int) -> bytes:
    """Sorted distinct values: the quotients of their differences in unary, padded to a byte, then the remainders of `shift` bits."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    stops = np.cumsum((gaps >> np.uint64(shift)).astype(np.int64) + 1) - 1
    unary = np.zeros(stops[-1] + 1 if len(stops) else 0, dtype=np.uint8)
    unary[stops] = 1
    rest = (gaps[:, None] >> np.arange(shift, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8)).tobytes()


def golomb_decode(code: bytes, n: int, shift: int) -> np.ndarray:
    bits = np.frombuffer(code, dtype=np.uint8)
    size = -(-n * shift // 8)
    stops = np.flatnonzero(np.unpackbits(bits[: len(bits) - size]))[:n]
    rest = np.unpackbits(bits[len(bits) - size :], count=n * shift).reshape(n, shift).astype(np.uint64)
    low = (rest << np.arange(shift, dtype=np.uint64)).sum(1, dtype=np.uint64)
    quotients = (np.diff(stops, prepend=-1) - 1).astype(np.uint64)
    return np.cumsum((quotients << np.uint64(shift)) + low, dtype=np.uint64)


def lowered(docs: DataFrame, sha: bool, text: bool) -> DataFrame:
    """docs(doc_id, text) -> doc_id, mark (64-bit hash), and as asked for sha (SHA-256) and text, of the text with A-Z lowered."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            view, ends = memoryview(data), offsets.tolist()
            parts = [view[a:b] for a, b in zip(ends, ends[1:])]
            marks = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
            columns = {"doc_id": batch.column("doc_id").cast(pa.int64()), "mark": pa.array(marks.view(np.int64))}
            if sha:
                columns["sha"] = pa.array([hashlib.sha256(p).digest() for p in parts], pa.binary())
            if text:
                columns["text"] = pa.Array.from_buffers(pa.large_string(), len(parts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, mark long" + ", sha binary" * sha + ", text string" * text)


class Space:
    """How fingerprints of n rows are cut out of hashes, and dealt to owners by their upper bits."""

    def __init__(self, n: int, least_owners: int, slack: int = SLACK):
        self.bits = min(62, max(n, 2).bit_length() + slack)
        self.owner_bits = min(self.bits - 1, max(least_owners - 1, n // OWNER_ROWS).bit_length())
        self.inner = self.bits - self.owner_bits

    def of(self, marks: np.ndarray) -> np.ndarray:
        return marks.astype(np.int64).view(np.uint64) >> np.uint64(64 - self.bits)

    def column(self):
        return F.shiftrightunsigned("mark", 64 - self.bits)


def packets(marks: DataFrame, space: Space) -> DataFrame:
    """lowered(sha=True) rows -> rows of PACKET; `code` goes to the owner, the rest stays the sender's."""

    def of_chunk(part: int, chunk: int, table: pa.Table) -> pa.RecordBatch:
        found = space.of(table.column("mark").to_numpy())
        order = np.argsort(found, kind="stable")
        distinct, first, counts = np.unique(found[order], return_index=True, return_counts=True)
        owners, at = np.unique(distinct >> np.uint64(space.inner), return_index=True)
        ids, shas = table.column("doc_id").take(pa.array(order)), table.column("sha").take(pa.array(order))
        bounds, row_bounds = np.append(at, len(distinct)), np.append(first, len(found))
        rows = []
        for owner, a, b in zip(owners.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            shift = golomb_shift(b - a, 1 << space.inner)
            code = golomb_encode(distinct[a:b] & np.uint64((1 << space.inner) - 1), shift)
            x, y = int(row_bounds[a]), int(row_bounds[b])
            rows.append((part, chunk, owner, b - a, shift, code, np.packbits(counts[a:b] > 1).tobytes(), counts[a:b].astype("<u4").tobytes(), ids.slice(x, y - x).to_pylist(), b"".join(shas.slice(x, y - x).to_pylist())))
        kinds = [pa.int32()] * 5 + [pa.binary()] * 3 + [pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PACKET.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= SENDER_ROWS:
                yield of_chunk(part, chunk, pa.Table.from_batches(held))
                chunk, held, n = chunk + 1, [], 0
        if n:
            yield of_chunk(part, chunk, pa.Table.from_batches(held))
        tidy()

    return marks.mapInArrow(task, PACKET)


def bitmaps(sent: DataFrame) -> DataFrame:
    """What owners return: (part, chunk, owner, seen), a bit for each fingerprint of a packet that another packet holds too."""

    def owner(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        values = np.concatenate([golomb_decode(c, n, s) for c, n, s in zip(table.column("code").to_pylist(), sizes.tolist(), table.column("shift").to_pylist())])
        order = np.argsort(values, kind="stable")
        same = values[order[1:]] == values[order[:-1]]
        seen = np.zeros(len(values), dtype=bool)
        seen[order[1:][same]] = True
        seen[order[:-1][same]] = True
        ends = np.cumsum(sizes)
        maps = [np.packbits(seen[b - n : b]).tobytes() for n, b in zip(sizes.tolist(), ends.tolist())]
        return pa.table({"part": table.column("part"), "chunk": table.column("chunk"), "owner": table.column("owner"), "seen": pa.array(maps, pa.binary())})

    return sent.select("part", "chunk", "owner", "n", "shift", "code").groupBy("owner").applyInArrow(owner, "part int, chunk int, owner int, seen binary")


def marked(sent: DataFrame, returned: DataFrame, space: Space) -> DataFrame:
    """Packets and their bitmaps -> doc_id, fingerprint, sha, suspect: a row for each document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, shift, code, again, seen, counts, shas, owner = (batch.column(c)[i].as_py() for c in ("n", "shift", "code", "again", "seen", "counts", "shas", "owner"))
                values = golomb_decode(code, n, shift) | (np.uint64(owner) << np.uint64(space.inner))
                suspect = np.unpackbits(np.frombuffer(again, np.uint8) | np.frombuffer(seen, np.uint8), count=n).astype(bool)
                times = np.frombuffer(counts, "<u4")
                sha = pa.Array.from_buffers(pa.binary(), len(shas) // 32, [None, pa.py_buffer(np.arange(0, len(shas) + 1, 32, dtype=np.int32)), pa.py_buffer(shas)])
                columns = [batch.column("ids").slice(i, 1).flatten(), pa.array(np.repeat(values, times).view(np.int64)), sha, pa.array(np.repeat(suspect, times))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fingerprint", "sha", "suspect"])
        tidy()

    total = returned.agg(F.sum(F.length("seen") + 40)).first()[0] or 0
    returned = F.broadcast(returned) if total <= BROADCAST_BYTES else returned
    return sent.join(returned, ["part", "chunk", "owner"]).mapInArrow(task, "doc_id long, fingerprint long, sha binary, suspect boolean")


def fingerprints(docs: DataFrame, slack: int = SLACK) -> tuple[DataFrame, Space]:
    """(marked rows, written; the space of their fingerprints): who is a suspect, by the exchange."""
    marks = written(lowered(docs, sha=True, text=False))
    space = Space(marks.count(), partitions(docs.sparkSession), slack)
    sent = written(packets(marks, space))
    discard(marks)
    returned = written(bitmaps(sent))
    rows = written(marked(sent, returned, space))
    discard(sent)
    discard(returned)
    return rows, space


def _few(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def classes(docs: DataFrame, rows: DataFrame, space: Space) -> DataFrame:
    """(sha, keep_id, group_size) of the texts that two rows or more have, verified on the suspects' bytes."""
    suspects = written(rows.where("suspect").select("fingerprint").distinct())
    texts = lowered(docs, sha=False, text=True).withColumn("fingerprint", space.column())
    met = texts.join(_few(suspects), "fingerprint", "left_semi")
    grouped = met.groupBy("fingerprint", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = written(grouped.where("group_size > 1").select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"))
    discard(suspects)
    return found


def labels(docs: DataFrame, slack: int = SLACK) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256: one row per document."""
    rows, space = fingerprints(docs, slack)
    found = _few(classes(docs, rows, space))
    shown = [F.lower(F.hex("sha")).alias("text_sha256")]
    alone = rows.where("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *shown)
    own, size = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), F.coalesce("group_size", F.lit(1).cast("long"))
    met = rows.where("suspect").join(found, "sha", "left").select("doc_id", own.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(own).alias("kept"), *shown)
    return alone.unionByName(met)


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of equal texts: the largest doc_id's, one of them if that row is repeated."""
    rows, space = fingerprints(docs)
    found = classes(docs, rows, space).select(F.col("sha").alias("_same_sha"), F.col("keep_id").alias("_same_keep_id"))
    discard(rows)
    keyed = docs.withColumn("_same_sha", F.unhex(F.sha2(F.translate(text_or_empty(), UPPER, LOWER), 256)))
    met = keyed.join(_few(found.withColumn("_same_class", F.lit(True))), "_same_sha", "left")
    stays = met.where(F.col("_same_class") & F.col("doc_id").eqNullSafe(F.col("_same_keep_id"))).dropDuplicates(["_same_sha"])
    return met.where("_same_class IS NULL").unionByName(stays).select(*docs.columns)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(documents(spark, sf_dir))


QUERIES = {"op11_exact_dedup": op11_exact_dedup}
ORACLES = {
    "op11_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size, sha256(low) AS text_sha256 FROM t GROUP BY low)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, doc_id IS NULL AND keep_id IS NULL) AS kept, text_sha256 FROM t JOIN g USING (low)"""
}
