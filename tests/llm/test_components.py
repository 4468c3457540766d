"""Components of short edge lists take no exchange, and equal those of the shuffled rounds."""

import random

from evalweave.llm import components


def _found(spark, pairs, few, monkeypatch):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    return {(r.node, r.root) for r in components.roots(spark.createDataFrame(pairs, "a long, b long")).collect()}


def test_rounds_of_few_edges_are_one_partition(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")
    for star in (components._large_star, components._small_star):
        plan = star(edges, True).distinct()
        assert plan.rdd.getNumPartitions() == 1
        assert "hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()


def test_few_and_many_edges_agree(spark, monkeypatch):
    draw = random.Random(3)
    pairs = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(5, 5)]
    assert _found(spark, pairs, 1 << 16, monkeypatch) == _found(spark, pairs, 0, monkeypatch)
