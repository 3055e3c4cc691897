"""Token-id output: documents in order of doc_id, as frames of adaptively range-coded ids, and back.

One shuffle by range of doc_id puts whole texts in order; each task then encodes its texts and packs their ids into frames of
about `FRAME_IDS` ids (whole documents; a longer document is a frame of its own). A row of the written Parquet file is one frame:
part, frame, first row in the part, doc_ids and counts of its documents, and the coded blocks (see range_coder). Reading takes
frames in any order; where each begins follows from the counts of ids in the frames before it, a table as small as the number
of frames.

write_ids is a job at once; read_ids is lazy.

Defined cases: null or empty text: the end id alone; null doc_id: first in order; repeated rows: a record each, in order of
text; very long texts: a frame of their own; empty table: no frames; further columns are left out of the files.
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

from . import range_coder
from .common import documents, partitions, scratch, tidy
from .tokens import SLICE_BYTES, encoder, slices

VOCABULARY, END_ID, FRAME_IDS = "byte_bpe_50k.json", 0, 4_000_000
FRAME = "part int, frame int, n_ids long, doc_ids array<long>, counts array<long>, blocks binary"


def with_end(values: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text, and the new offsets."""
    return np.insert(values, offsets[1:], end_id), offsets + np.arange(len(offsets))


def frames(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text) -> rows of FRAME, in order of doc_id by (part, frame)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, values, counts, held = [], [], [], 0

        def frame() -> pa.RecordBatch:
            whole = np.concatenate(values)
            row = [[part], [number], [len(whole)], [sum(ids, [])], [np.concatenate(counts).tolist()], [range_coder.encode(whole)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(row, kinds)], names=["part", "frame", "n_ids", "doc_ids", "counts", "blocks"])

        for batch in batches:
            for some in slices(batch, size=8 * SLICE_BYTES):
                v, o = with_end(*encoder(vocabulary).ids(some.column("text")), end_id)
                ids.append(some.column("doc_id").to_pylist())
                values.append(v)
                counts.append(np.diff(o))
                held += len(v)
                if held >= FRAME_IDS:
                    yield frame()
                    ids, values, counts, held, number = [], [], [], 0, number + 1
        if held:
            yield frame()
        ids, values, counts = [], [], []
        tidy()

    # ranges of doc_id alone, for the keys sampled to find them go to the driver; equal ids are in one range and then in order of text
    ranged = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return ranged.mapInArrow(task, FRAME)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    frames(docs, vocabulary, end_id).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for."""
    files = spark.read.schema(FRAME).parquet(path)
    sums = files.select("part", "frame", "n_ids")
    parts = sums.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("part_base"))
    inner = sums.withColumn("base", F.sum("n_ids").over(Window.partitionBy("part").orderBy("frame")) - F.col("n_ids"))
    bases = inner.join(before, "part").select("part", "frame", (F.col("base") + F.col("part_base")).alias("base"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = range_coder.decode(row["blocks"])
                ends = np.cumsum(row["counts"])
                if ends[-1] != len(values):
                    raise ValueError(f"part {row['part']}, frame {row['frame']}: its documents have {ends[-1]} ids, its blocks {len(values)}")
                starts = ends - row["counts"]
                wide = values.astype("<u4")
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(ends)
                columns = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["frame"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64())]
                names = ["part", "frame", "doc_id", "inner", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), wide.astype(np.int32)).cast(pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                del values, wide, columns
        tidy()

    schema = "part int, frame int, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = files.mapInArrow(task, schema)
    found = rows.join(bases, ["part", "frame"]).withColumn("start", F.col("base") + F.col("inner"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_ids(documents(spark, sf_dir), path, public_tokenizers.path(VOCABULARY))
    return read_ids(spark, path, with_ids=False)


QUERIES = {"op1_token_output": op1_token_output}
ORACLES: dict[str, str] = {}
