"""What the detector keeps and shuffles, and the overlap of windows against brute force."""

import numpy as np
import pytest

from quillmill.functions import overlap
from quillmill.operators import detector, scoring, text

SF = "/root/testdata/sf0.001"


def plain(grams, total, size, stride):
    n, count = total - len(grams) + 1, 1 if total <= size else -(-(total - size) // stride) + 1
    sets = [set(grams[i * stride : max(i * stride, min(i * stride + size, total) - n + 1)].tolist()) for i in range(count)]
    best, other = [0.0] * count, [-1] * count
    for w in range(count):
        for o in range(count):
            both = len(sets[w] & sets[o]) if abs(o - w) >= 2 else 0
            if both and both / (len(sets[w]) + len(sets[o]) - both) > best[w]:
                best[w], other[w] = both / (len(sets[w]) + len(sets[o]) - both), o
    return best, other


@pytest.mark.parametrize("cells", [7, 100, overlap.CELLS])
def test_overlap_is_exact(monkeypatch, cells):
    monkeypatch.setattr(overlap, "CELLS", cells)
    r = np.random.default_rng(cells)
    for i in range(100):
        size, stride, n = int(r.integers(5, 40)), int(r.integers(1, 45)), int(r.integers(1, 6))
        total = int(r.integers(size + stride + 1, 400))
        known = r.integers(-(2**63), 2**63, int(r.choice([3, 20, 200, 100000])), dtype=np.int64)
        grams = known[r.integers(0, len(known), total - n + 1)] if i % 3 else np.resize(known[: int(r.integers(1, 60))], total - n + 1)
        best, other = overlap.similar(grams, total, size, stride)
        assert (best.tolist(), other.tolist()) == plain(grams, total, size, stride)


def test_overlap_needs_no_shuffle(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    found = detector.window_overlap(detector.tokenised(rows), 100, 50, 5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_kept_tables_hold_neither_tokens_nor_spare_texts(spark):
    rows = text.docs(spark, SF)
    for result, columns in ((detector.shared(rows), {"doc_id", "lang", "detector"}), (detector.shared(rows, detector.SMALL, "text"), {"doc_id", "lang", "text", "detector"})):
        assert set(result.columns) == columns and not any("array<string>" in kind for _, kind in result.dtypes)
        result.unpersist()


def test_partitions_grow_with_the_file(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert text.dealt(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(text, "SPREAD", 10_000)
    assert text.dealt(table).rdd.getNumPartitions() > 8


def test_style_makes_words_once(spark):
    rows = spark.createDataFrame([("A word. Two words, and more.",)], "text string")
    plan = rows.select(detector.style_of_text(rows.text))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 4  # 28 where each window of the vocabulary made them anew


def test_kept_rows_are_computed_before_several_stages_read_them(spark):
    stored = lambda: {x.id(): x.numCachedPartitions() == x.numPartitions() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
    for query in (detector.ai_report, detector.ai_report_small, detector.ai_windows, detector.ai_evidence_repeats, scoring.evidence):
        spark.catalog.clearCache()
        result = query(spark, SF)
        assert list(stored().values()) == [True] and result.columns
