"""Measures that share a table of texts and tokens read the documents once, and let it go afterwards."""

import gc

from quillmill.operators import detector, scoring, text
from quillmill.plans import engine

SF = "/root/testdata/sf0.001"


def scans(frame):
    """File scans in a plan, those of a kept table once."""
    plan = frame._jdf.queryExecution().executedPlan()
    seen, todo, n = set(), [plan], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "InMemoryTableScan" in name:
            builder = node.relation().cacheBuilder()
            if builder.hashCode() not in seen:
                seen.add(builder.hashCode())
                todo.append(builder.cachedPlan())
            continue
        n += name.startswith("Scan parquet")
        if name == "AdaptiveSparkPlan":
            todo.append(node.inputPlan())
            continue
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return n


def test_one_scan(spark):
    for query in (scoring.health_scores, detector.ai_report, detector.ai_evidence, engine.report_scalars):
        assert scans(query(spark, SF)) == 1


def test_kept_tables_are_let_go(spark):
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    gc.collect()
    text.kept(spark.range(1)).unpersist()
    before = held()
    result = detector.ai_report(spark, SF)
    result.count()
    assert held() == before + 1
    derived = result.select("doc_id")
    del result
    gc.collect()
    text.kept(spark.range(1)).unpersist()
    assert held() == before and derived.count() == 200  # goes on from the files
    tables = engine.analyze(spark.createDataFrame([(1, "T", "en", "Chapter 1\nJohn walked home.")], "doc_id long, title string, lang string, text string"))
    assert tables["chapters"].count() == 1 and held() > before
    tables.release()
    assert held() == before
