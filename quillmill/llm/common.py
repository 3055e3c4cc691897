"""Shared pieces of the training-data operators: the shared folder, tables written to cut lineage, base expressions."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of `[^\x20\x09-\x0D]+` words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Items to a run of scanned().
RUN = 64

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing a temporary folder stands in, if driver and executors are one process; else it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that all of them share")
        base = _own.get("dir") or _own.setdefault("dir", tempfile.mkdtemp(prefix="quillmill-"))
    return f"{base.rstrip('/')}/quillmill-{uuid.uuid4().hex}"


def tidy() -> None:
    """Give back memory that this worker no longer uses: idle workers stay with their executor and count towards its limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Paths that are still there, by path, with what it takes to remove them.
_scratch: dict[str, tuple] = {}


#: Removes a query's shuffle files when it ends; else they stay until the driver's JVM collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries run herein leave no shuffle files: nothing reads those of a table that is read back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, **options: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    The table is removed by discard(), or when the driver's Python ends.
    """
    path = scratch(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def scratch(spark: SparkSession) -> str:
    """A new shared_dir() whose files go when the driver's Python ends."""
    path = shared_dir(spark)
    _scratch[path] = (spark._jvm, spark._jsc.hadoopConfiguration())
    return path


def _remove(path: str, jvm, conf) -> None:
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def discard(table: DataFrame) -> None:
    """Remove the files of a written() table that nothing will read again."""
    _remove(table.scratch, *_scratch.pop(table.scratch))


@atexit.register
def _sweep() -> None:
    for path, kept in _scratch.items():
        try:
            _remove(path, *kept)
        except (Py4JError, OSError):  # the JVM has ended before
            return


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: str = "text") -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def scanned(items: str, state: str, kind: str, keep: str, value: str, after: str) -> str:
    """SQL of a running pass over the array `items`: an array<kind> of `value` for the items that `keep`, with the state before each.

    In keep, value and after, `s` is the state and `x` the item; the state begins as `state` and goes on as `after`. Results are
    gathered in runs of RUN items, so appending to immutable arrays does not cost the square of their length.
    """
    run = f"""aggregate(slice(_items, _run * {RUN} + 1, {RUN}), named_struct('s', _all.s, 'own', cast(array() as array<{kind}>)),
      (_one, x) -> transform(array(_one.s), s -> named_struct('s', {after}, 'own', if({keep}, concat(_one.own, array({value})), _one.own)))[0])"""
    return f"""transform(array({items}), _items -> flatten(aggregate(
      if(size(_items) > 0, sequence(0, (size(_items) - 1) div {RUN}), cast(array() as array<int>)),
      named_struct('s', {state}, 'out', cast(array() as array<array<{kind}>>)),
      (_all, _run) -> transform(array({run}), _done -> named_struct('s', _done.s, 'out', concat(_all.out, array(_done.own))))[0],
      _all -> _all.out)))[0]"""


def matches(text: str, pattern: str, context: int = 24) -> str:
    """SQL: array<struct<start, stop, value, before, after>> of the matches of a pattern (SQL too); lengths of what stands between give their places.

    before: up to `context` characters before the match, back to the last match but one at most; after: the character behind it,
    empty if the next match or the end is there.
    """
    items = f"""transform(array(named_struct('g', split({text}, {pattern}, -1), 'h', regexp_extract_all({text}, {pattern}, 0))), z ->
      transform(z.h, (v, i) -> named_struct('gap', length(z.g[i]), 'size', length(v), 'value', v, 'before', right(concat(if(i > 0, get(z.h, i - 1), ''), z.g[i]), {context}), 'after', left(z.g[i + 1], 1))))[0]"""
    value = "named_struct('start', s + x.gap, 'stop', s + x.gap + x.size, 'value', x.value, 'before', x.before, 'after', x.after)"
    return scanned(items, "0", "struct<start:int,stop:int,value:string,before:string,after:string>", "true", value, "s + x.gap + x.size")
