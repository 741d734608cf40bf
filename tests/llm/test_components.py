"""Components are whole, however many rounds they take."""

import random

import pytest

from tributary.llm import common, components


def test_long_paths_are_whole(spark):
    nodes = list(range(300))
    random.Random(1).shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "src long, dst long")
    got = components.connected_components(edges).collect()
    assert len(got) == 299 and {c for _, c in got} == {0}  # the smallest node stands for itself
    assert components.connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, components.FEW])
def test_rounds_and_one_task_agree_with_a_search(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(3)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(5, 5), (None, 1), (2, None), (2**62, -(2**63)), (0, 1), (1, 0)]
    label = {n: n for p in pairs if None not in p for n in p}
    for _ in label:
        for x, y in pairs:
            if x is not None and y is not None:
                label[x] = label[y] = min(label[x], label[y])
    got = components.connected_components(spark.createDataFrame(pairs, "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == sorted((n, c) for n, c in label.items() if n != c)


def test_few_edges_take_few_jobs(spark):
    """Each round's plans and tasks would stay with the driver for a while."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long")
    spark.sparkContext.setJobGroup("few-edges", "")
    try:
        components.connected_components(edges)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")) < 8


def test_the_driver_collects_what_plans_leave(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    before = whole()
    assert common.materialize(spark.range(3), "three").count() == 3
    assert whole() > before
