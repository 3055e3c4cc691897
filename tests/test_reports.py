"""A report's chapters are passed over once, and its names are looked for in one pass over a text."""

import random

from pyspark.sql import functions as F

from quillmill.functions.mentions import mentioned
from quillmill.operators import characters
from quillmill.plans import engine

SF = "/root/testdata/sf0.001"


def nodes(frame):
    """Nodes of a plan down to kept tables."""
    todo = [frame._jdf.queryExecution().withCachedData()]
    while todo:
        node = todo.pop()
        yield node
        todo += [node.children().apply(i) for i in range(node.children().size())]


def test_chapter_tables_leave_texts_alone(spark):
    rows = spark.createDataFrame([(1, "T", "en", "Chapter 1\nJohn left in 1999.")], "doc_id long, title string, lang string, text string")
    tables = engine.analyze(rows)
    for name in ("metrics", "summaries", "characters", "genres", "genre_reasons", "structure", "contradictions", "timeline", "beats"):
        assert not [x for n in nodes(tables[name]) for x in [n.expressions().toString()] if "regexp" in x or "c#" in x.split("text")[0]], name
    tables.release()


def test_what_reports_share_is_filled(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    full = engine.report_scalars(spark, SF)
    shared = full.tables.shared
    held = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    assert len(shared) == 2 and sum(1 for x in held if x.numCachedPartitions() == x.numPartitions()) >= before + 2
    full.tables.release()


def test_names_against_search_in_each_sentence(spark):
    r = random.Random(4)
    parts = ["Ann", "anna", "Joh", "John", "johnson", "McDonald", "Don", "don", "xJohn", "Johnson", "Ana", "the", "left", "because", "Élan", "Kin", "Kin", "kind"]
    for _ in range(200):
        sentences = ["".join(r.choice(parts) + r.choice(["", " ", "'", "-"]) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 12))]
        weights, names = [r.choice([0, 1, 3, 4]) for _ in sentences], ["Ann", "Joh", "John", "Johnson", "Don", "Kin", "Zoe"]
        order = sorted(range(len(sentences)), key=lambda i: -weights[i])
        want = [(sum(s.count(n) for s in sentences), [i for i in order if n.lower() in sentences[i].lower()][:3]) for n in names]
        assert mentioned(names, sentences, weights, 3) == want


def test_many_names_carry_no_text(spark):
    rows = spark.createDataFrame([(1, 1, "T", "John left. Mary said John was here.")], "doc_id long, chapter int, title string, text string")
    found = characters.character_chapters(rows)
    assert not [n for n in nodes(found) if n.nodeName() == "Generate" and "text" in n.output().toString()]
    assert sorted(map(tuple, found.select("name", "mentions", F.array_join("actions", "|")).collect())) == [("John", 2, "John left.|Mary said John was here."), ("Mary", 1, "Mary said John was here.")]
