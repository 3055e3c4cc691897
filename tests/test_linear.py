"""Operators whose cost once followed the square of a text: their plans, and their time on long texts."""

import time

from pyspark.sql import functions as F

from quillmill.operators import detector, timeline
from quillmill.sources import corpus


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def seconds(frame):
    began = time.perf_counter()
    n = frame.count()
    return time.perf_counter() - began, n


def test_no_join_by_range(spark):
    rows = spark.createDataFrame([(1, "en", "x")], "doc_id long, lang string, text string")
    lines = spark.createDataFrame([(1, 0, "x")], "doc_id long, pos int, line string")
    for frame in (detector.paragraph_places(detector.paragraphs(detector.tokenised(rows)), 900, 450), corpus.headers(lines)):
        joins = [x for x in plan(frame).split("\n") if "Join" in x]
        assert not any("<" in x or ">" in x or "NestedLoop" in x or "Cartesian" in x for x in joins), joins


def test_touched_windows_are_those_that_overlap(spark):
    cases = [(f, e, t, size, stride) for t in (1, 30, 95, 200) for size, stride in ((10, 5), (10, 10), (10, 25), (90, 7)) for f in range(0, t, 9) for e in range(f + 1, t + 1, 13)]
    for size, stride in {c[3:] for c in cases}:
        own = [c for c in cases if c[3:] == (size, stride)]
        frame = spark.createDataFrame(own, "f int, e int, t int, size int, stride int").select("f", "e", "t", detector.touched(F.col("f"), F.col("e"), F.col("t"), size, stride).alias("ws"))
        for r in frame.collect():
            n = 1 if r.t <= size else -(-(r.t - size) // stride) + 1
            assert (r.ws or []) == [w for w in range(n) if w * stride < r.e and r.f < min(w * stride + size, r.t)], r


def test_repeated_paragraphs_of_a_long_text(spark):
    para = lambda i: " ".join(f"w{i % 40}x{k}" for k in range(50))
    text = lambda n: "\n\n".join(para(i) for i in range(n))
    frames = [detector.paragraph_places(detector.paragraphs(detector.tokenised(spark.createDataFrame([(1, "en", text(n))], "doc_id long, lang string, text string"))), 100, 50) for n in (40, 2000)]
    seconds(frames[0])
    (took, n) = seconds(frames[1])
    assert n > 3900 and took < 20  # 100,000 words


def test_many_markers_cost_what_their_text_costs(spark):
    text = " and then é walked on at the far end of it, ".join(["the next day"] * 20_000)
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    seconds(timeline.events_around(rows, 10))
    took, n = seconds(timeline.events_around(rows, 100_000))
    assert n == len(timeline.events_around(rows, 100_000).collect()) >= 20_000 and took < 20


def test_cuts_between_bytes(spark):
    text = "中" * 50 + " next day " + "é" * 70
    got = timeline.events_around(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.event == "中" * 26 + " next day " + "é" * 59 and got.time_marker == "next day"  # 79 bytes before, 119 behind


def test_each_line_goes_to_the_header_above_it(spark):
    lines = ["Some words before it", "Chapter 1: Untitled", "a b", "The first real line. More", "Chapter 2", "Chapter 3: Named", "one two three"]
    got = corpus.headers(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, line string")).orderBy("pos").collect()
    assert [(r.number, r.title) for r in got] == [("1", "The first real line"), ("2", "Chapter 2"), ("3", "Named")]
