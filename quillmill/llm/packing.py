"""Packing token ids into fixed windows: concatenate and cut.

First pass: each task encodes its documents and writes their ids with the running count of ids before each in the task. The
totals of the tasks (a row per task) give every task its global offset. Second pass: a document's global offset places it in
windows of `WINDOW` ids; it is cut where a window ends, and each piece is a record of its own. Texts are encoded once and never
shuffled, and only the last window has padding.

The order of documents is that of the input's splits and rows, and is pinned by the table that the first pass writes.

The first pass is a job at once, the second is lazy.

Defined cases: null or empty text: the end id alone; null or repeated doc_id: rows are packed one by one; very long texts: as many
pieces as they need; empty table: no pieces; further columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, tidy, written
from .token_output import with_end
from .tokens import encoder, slices

VOCABULARY, END_ID, WINDOW = "word_bpe_49k.json", 1, 2048
#: Ids take two bytes: vocabularies have fewer than 65,536.
ENCODED = "part int, inner long, doc_id long, n long, ids binary"


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text) -> ENCODED: ids, and the ids before them in their task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch):
                values, offsets = with_end(*encoder(vocabulary).ids(some.column("text")), end_id)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), some.num_rows, [None, pa.py_buffer(offsets * 2), pa.py_buffer(np.ascontiguousarray(values))])
                n = np.diff(offsets)
                columns = [pa.array([part] * some.num_rows, pa.int32()), pa.array(offsets[:-1] + before), some.column("doc_id").cast(pa.int64()), pa.array(n), ids.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "inner", "doc_id", "n", "ids"])
                before += int(offsets[-1])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(task, ENCODED)


def offsets(table: DataFrame) -> DataFrame:
    """(part, base): ids in all tasks before, from one total per task."""
    totals = table.groupBy("part").agg(F.sum("n").alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))


def cut(table: DataFrame, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """ENCODED -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            first = batch.column("base").to_numpy() + batch.column("inner").to_numpy()
            pieces = (first + n - 1) // window - first // window + 1
            owner = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[owner] // window + nth
            begin = np.maximum(first[owner], sequence * window)
            end = np.minimum(first[owner] + n[owner], (sequence + 1) * window)
            start, length = begin - first[owner], end - begin
            wide = [np.frombuffer(b, "<u2").astype("<u4") for b in batch.column("ids").to_pylist()]
            parts = [wide[o][s : s + k] for o, s, k in zip(owner.tolist(), start.tolist(), length.tolist())]
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(n[owner]), pa.array(sequence), pa.array(begin - sequence * window)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        tidy()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return table.join(F.broadcast(offsets(table)), "part").select("doc_id", "inner", "base", "n", "ids").mapInArrow(task, schema)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The offsets that are broadcast have one row per task of the first pass."""
    return cut(written(encoded(docs, vocabulary, end_id)), window, with_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), with_ids=False)


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
