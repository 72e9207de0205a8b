"""Connected components against union-find, and the stages that a round takes."""

import random

from hanmaru.llm import common


def test_components_take_few_stages_a_round(spark, monkeypatch):
    rng = random.Random(3)
    ids = rng.sample(range(-(1 << 61), 1 << 61), 900)
    links = [(ids[i], ids[i + 1]) for i in range(200)]  # a chain
    links += [(ids[300], ids[301 + i]) for i in range(200)] + [(max(ids), x) for x in ids[600:700]]  # hubs
    links += [tuple(rng.sample(ids[700:], 2)) for _ in range(90)] + links[:50] + [(b, a) for a, b in links[50:90]]
    links += [(ids[0], ids[0]), (ids[250], ids[250]), (None, ids[1])]
    root = {x: x for a, b in links if None not in (a, b) and a != b for x in (a, b)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if None not in (a, b) and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    rounds, write = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df, name: (rounds.append(name), write(df, name))[1])
    sc = spark.sparkContext
    sc.setJobGroup("components", "components")
    try:
        found = common.connected_components(spark.createDataFrame(links, "a long, b long"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    got = [(r.node, r.root) for r in found.collect()]
    assert len(got) == len(root) and dict(got) == {x: find(x) for x in root}
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    ran = sum(bool((i := tracker.getStageInfo(s)) and i.numCompletedTasks) for s in stages)
    assert ran <= 2 + 6 * (len(rounds) - 1)  # the first is the links themselves


def test_components_without_links(spark):
    assert common.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
