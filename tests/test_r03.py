"""Findings of round 3: ties at limits as in SQL, and what is kept or shuffled for a report."""

from pyspark.sql import functions as F

from quillmill.operators import slop, text
from quillmill.plans import engine


def test_deviation_at_its_limit_is_that_of_sql(spark):
    # lengths whose deviation is 4 by sums of squares, and 3.9999999999999996 by the steps that SQL's stddev_pop takes
    rows = [(i, " ".join("word " * n + "." for n in lengths)) for i, lengths in enumerate([(1, 1, 11, 6, 1), (1, 3, 12, 5, 9), (4, 12)])]
    got = {r.doc_id: r for r in slop.slop(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].sentence_sd for i in range(3)] == [3.9999999999999996, 3.9999999999999996, 4.0]
    assert [slop.FLAGS[0] in got[i].flags for i in range(3)] == [True, True, False]


def _joined_columns(plan):
    """Names of the columns that go into the joins and windows of a plan."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    own = {c.output().apply(i).name() for c in children for i in range(c.output().size())} if plan.nodeName() in ("Join", "Window") else set()
    return own.union(*map(_joined_columns, children))


def test_report_keeps_each_text_once_and_shuffles_none(spark):
    rows = spark.createDataFrame([(i, "T", "en", f"Chapter 1\nJohn {i} left today because it rained.\n" + "word " * 3000) for i in range(4)] + [(9, "T", "en", "")], "doc_id long, title string, lang string, text string")
    tables = engine.analyze(rows)
    whole = [x.columns for x in tables.shared]
    assert all("text" not in x for x in whole) and sum("chapters" in x for x in whole) == 1
    for name in ("beats", "timeline"):  # a row that is joined or put in order has at most the head of its chapter
        assert _joined_columns(tables[name]._jdf.queryExecution().optimizedPlan()).isdisjoint({"text"})
    got = {r.doc_id: r for r in engine.report(rows, tables).collect()}
    counted = {r.doc_id: r.n for r in text.segments(rows).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {i: r.n_segments for i, r in got.items()} == {**counted, 9: None} and got[0].word_count == 3009
