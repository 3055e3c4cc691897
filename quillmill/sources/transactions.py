"""Several tables as one transaction: each commit writes its tables to a folder of its own, and one renamed manifest makes all of them visible at once.

    <root>/data/<number>-<random>/<table>/   the tables of one commit
    <root>/manifests/<number>.json           which folder, tables and schemas make up that version

Readers take the tables that the last manifest names, so a writer that stops between two tables leaves the version before it readable. Of
two writers of one version the file system lets one rename its manifest; the other raises Conflict. Renames are atomic on HDFS and
local disks; an object store needs a committer that gives the same for one small file.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions, in order."""
    folder = _path(spark, f"{root}/manifests")
    files = _files(spark, root)
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: int | None = None) -> int:
    """Write all tables, then make them the next version; its number. expected: the version that they were made from, Conflict if it is no longer the last."""
    last = max(versions(spark, root), default=0)
    if expected is not None and last != expected:
        raise Conflict(f"version {last} was committed after {expected}")
    number, folder = last + 1, f"data/{last + 1:012d}-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{root}/{folder}/{name}")
    told = json.dumps({"folder": folder, "tables": {name: table.schema.jsonValue() for name, table in tables.items()}}, indent=1)
    files, draft = _files(spark, root), _path(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(told.encode()))
    finally:
        out.close()
    names = spark._jvm.org.apache.hadoop.fs
    context = names.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(names.Options.Rename, 1)
    options[0] = getattr(names.Options.Rename, "NONE")  # never over a manifest that is there
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(_path(spark, f"{root}/manifests/{number:012d}.json")), options)
    except Py4JJavaError as e:
        files.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"version {number} was committed meanwhile") from e
        raise
    return number


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    number = version or max(versions(spark, root), default=0)
    if not number:
        raise FileNotFoundError(f"nothing is committed below {root}")
    rows = spark.read.text(f"{root}/manifests/{number:012d}.json", wholetext=True).collect()  # one small file
    return json.loads(rows[0].value)


def read(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the last one by default."""
    told = manifest(spark, root, version)
    return {name: spark.read.schema(StructType.fromJson(schema)).parquet(f"{root}/{told['folder']}/{name}") for name, schema in told["tables"].items()}


def clean(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove what the last `keep` versions do not name: older versions, and what stopped writers left up to the last commit; names of the folders removed.

    Folders of the number after the last one may belong to a writer that is still at work, and stay.
    """
    numbers, files = versions(spark, root), _files(spark, root)
    if not numbers:
        return []
    kept = {manifest(spark, root, n)["folder"] for n in numbers[-keep:]}
    for n in numbers[:-keep]:
        files.delete(_path(spark, f"{root}/manifests/{n:012d}.json"), False)
    gone = []
    for status in files.listStatus(_path(spark, f"{root}/data")):
        name = status.getPath().getName()
        if f"data/{name}" not in kept and int(name.split("-")[0]) <= numbers[-1]:
            files.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
