"""Connected components: few tasks a round, right whatever the graph."""

import random

from quillmill.llm import common, components


def _roots(links):
    at = {}

    def find(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            at[b] = a
    return {x: find(x) for x in at}


def test_a_round_shuffles_three_times(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(200)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7), (-5, 3)]
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = common.written(spark.createDataFrame([(max(a, b), min(a, b)) for a, b in links if a != b], "x long, y long").distinct())
        spark.sparkContext.setJobGroup("one round", "")
        common.discard(common.written(components._round(edges, None)))
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("one round") for s in tracker.getJobInfo(j).stageIds}
        tasks = [i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i and i.numCompletedTasks]
        assert len(tasks) == 4, tasks  # a scan, and one stage behind each shuffle
    finally:
        spark.sparkContext.setJobGroup("", "")
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for star in (components.STAR, 30):  # with 30, nodes above 30 links are hubs
        before, components.STAR = components.STAR, star
        try:
            assert {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()} == _roots(links)
        finally:
            components.STAR = before
