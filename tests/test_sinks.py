"""Transactions with stopped writers, projects set-wise, progress within a write, and tails of streams after a restart."""

import json
import os
import random
import subprocess
import sys
import textwrap
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmill.plans import engine
from quillmill.sources import transactions, workspace
from quillmill.streaming import logs

ROOT = Path(__file__).resolve().parents[1]


def pair(spark, n):
    return spark.createDataFrame([(i, f"e{n}") for i in range(n)], "id long, name string"), spark.createDataFrame([(i, n) for i in range(n)], "id long, entity_id long")


def names(spark, root):
    found = transactions.read(spark, root)
    return {r.name for r in found["entities"].collect()}, found["contradictions"].count()


def test_a_failed_writer_leaves_the_old_pair(spark, tmp_path):
    root = str(tmp_path / "db")
    with pytest.raises(FileNotFoundError):
        transactions.read(spark, root)
    assert workspace.commit_tables(*pair(spark, 3), root) == 1 and names(spark, root) == ({"e3"}, 3)
    entities, contradictions = pair(spark, 5)
    with pytest.raises(Exception, match="stopped here"):
        workspace.commit_tables(entities, contradictions.withColumn("entity_id", F.expr("if(id = 4, raise_error('stopped here'), entity_id)")), root)
    assert names(spark, root) == ({"e3"}, 3) and transactions.versions(spark, root) == [1]
    assert workspace.commit_tables(*pair(spark, 2), root) == 2 and names(spark, root) == ({"e2"}, 2)
    assert {r.name for r in transactions.read(spark, root, 1)["entities"].collect()} == {"e3"}
    gone = transactions.clean(spark, root, keep=1)
    assert len(gone) == 2 and transactions.versions(spark, root) == [2] and names(spark, root) == ({"e2"}, 2)


def test_a_killed_writer_leaves_the_old_pair(spark, tmp_path):
    """A process that ends at once after the first table of two."""
    root = str(tmp_path / "db")
    workspace.commit_tables(*pair(spark, 3), root)
    script = textwrap.dedent(f"""
        import os
        from pyspark.sql import SparkSession
        from quillmill.sources import transactions
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path / 'w')!r}).getOrCreate()
        class Kills:
            schema = spark.range(1).schema
            write = property(lambda self: os._exit(9))
        transactions.commit(spark, {root!r}, {{"entities": spark.range(7).selectExpr("id", "'new' AS name"), "contradictions": Kills()}})
    """)
    done = subprocess.run([sys.executable, "-c", script], env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, timeout=200)
    assert done.returncode == 9, done.stderr[-2000:]
    assert len(list((tmp_path / "db" / "data").iterdir())) == 2  # the first table is there, unseen
    assert names(spark, root) == ({"e3"}, 3) and workspace.commit_tables(*pair(spark, 4), root) == 2 and names(spark, root) == ({"e4"}, 4)


def test_one_of_two_writers_of_a_version_wins(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "db")
    workspace.commit_tables(*pair(spark, 1), root)
    with pytest.raises(transactions.Conflict):
        transactions.commit(spark, root, {"a": spark.range(1)}, expected=0)
    seen = transactions.versions
    monkeypatch.setattr(transactions, "versions", lambda *a: [])  # as a writer that looked before the first commit
    with pytest.raises(transactions.Conflict):
        transactions.commit(spark, root, {"a": spark.range(1)})
    monkeypatch.setattr(transactions, "versions", seen)
    assert names(spark, root) == ({"e1"}, 1) and not [f for f in os.listdir(tmp_path / "db" / "manifests") if f.startswith(".") and not f.endswith(".crc")]


def test_a_thousand_projects_twice(spark, tmp_path):
    root = str(tmp_path / "ws")
    rows = [(f" Title {i} ", f"../in/source{i}.docx", bytes([i % 256])) for i in range(1000)]
    frame = spark.createDataFrame(rows + [("title 7", "other.docx", b"a")], "title string, name string, content binary").repartition(3)
    made = workspace.create_projects(frame, root).collect()
    ids = {r[0] for r in spark.createDataFrame(rows, "title string, name string, content binary").select(workspace.project_id(F.col("title"))).collect()}
    assert len(made) == 1000 and {r.project_id for r in made} == ids
    files = {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in Path(root, "reports").rglob("*.json")}
    assert len(files) == 1000 and json.loads(next(iter(files.values()))[1])["analysis"] is None
    changed = next(iter(files))
    changed.write_text('{"title":"x","analysis":"kept"}\n')
    Path(changed.parent, f".{changed.name}.crc").unlink(missing_ok=True)
    files[changed] = (changed.stat().st_mtime_ns, changed.read_bytes())
    again = spark.createDataFrame(rows[:500] + [("Brand New", "n.docx", b"n")], "title string, name string, content binary")
    assert len(workspace.create_projects(again, root).collect()) == 501
    after = {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in Path(root, "reports").rglob("*.json")}
    assert {p: v for p, v in after.items() if p in files} == files and len(after) == 1001
    assert spark.read.parquet(f"{root}/sources").count() == 1001


def test_percent_rises_within_one_write(spark, tmp_path):
    told = []
    trace = logs.Trace(lambda percent, stage, detail: told.append((percent, stage, detail)))
    slow = spark.range(0, 24, 1, 24).mapInPandas(lambda frames: (__import__("time").sleep(0.25) or f for f in frames), "id long")
    engine.save({"slow": slow, "next": spark.range(3)}, str(tmp_path / "t"), trace, every=0.2)
    inside = [p for p, stage, detail in told if stage == "slow" and "tasks" in detail]
    percents = [p for p, *_ in told]
    assert len(set(inside)) >= 2 and all(0 < p < 50 for p in inside) and percents == sorted(percents) and percents[-1] == 100
    told.clear()
    with pytest.raises(Exception, match="broken"):
        engine.save({"bad": spark.range(1).select(F.expr("raise_error('broken')").cast("int").alias("x"))}, str(tmp_path / "u"), trace)
    assert told[-1][1] == "bad" and told[-1][2].startswith("failed: ") and trace.lines(spark).count() > 4
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_the_tail_of_a_stream_is_that_of_its_table(spark, tmp_path, rocks):
    """Lines out of order within the delay, in three files, each read by a query of its own that goes on from the checkpoint."""
    r = random.Random(3)
    begin = datetime(2026, 1, 1)
    lines = [(i, f"u{r.randrange(4)}", begin + timedelta(minutes=i), r.choice(["read", "write", None])) for i in range(240)]
    shuffled = sorted(lines, key=lambda x: x[0] + r.randrange(8))
    schema = "event_id long, user string, ts timestamp, stage string"
    table = spark.createDataFrame(lines, schema)
    end = [(10**6 + k, f"u{k}", begin + timedelta(days=9), "end") for k in range(4)]  # lets the watermark pass all of them
    folder, out = tmp_path / "in", str(tmp_path / "out")
    told = []
    listener = logs.StreamTrace(logs.Trace(lambda percent, stage, detail: told.append((percent, detail))))
    spark.streams.addListener(listener)
    for part in (shuffled[:80], shuffled[80:160], shuffled[160:], end):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        tails = logs.tail_stream(stream, "event_id", "user", 8, ["stage"], delay="10 minutes")
        query = tails.writeStream.foreachBatch(lambda rows, _: rows.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    spark.streams.removeListener(listener)
    given = spark.read.parquet(out).where("event_id < 1000000")
    got = {tuple(x) for x in logs.latest(given, "user").select("event_id", "user", "stage").collect()}
    before = [x for x in sorted(lines)]
    want = set()
    for user in {x[1] for x in lines}:
        own = [x for x in before if x[1] == user]
        kept = [x for i, x in enumerate(own) if i == 0 or x[3] != own[i - 1][3]]
        want |= {(x[0], user, x[3]) for x in kept[-8:]}
    assert got == want
    batch = logs.tail(logs.without_runs(table.withColumn("stage", F.coalesce("stage", F.lit("none"))), "event_id", "user", ["stage"]), "event_id", 8, "user")
    assert {(x.event_id, x.user, None if x.stage == "none" else x.stage) for x in batch.collect()} == got
    assert any("rows" in detail for _, detail in told) and any(detail == "done" for _, detail in told)
