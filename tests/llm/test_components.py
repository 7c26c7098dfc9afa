import random

import pytest

from spanveil.llm import components as at


def roots_of(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = {}
    for node in sorted(near):
        if node not in found:
            reached = [node]
            found[node] = node
            for x in reached:
                for y in near[x] - found.keys():
                    found[y] = node
                    reached.append(y)
    return {(a, root) for a, root in found.items() if a != root}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_edges_joined_at_once_and_in_rounds_give_the_same_roots(spark, kind):
    draw = random.Random(7)
    names = draw.sample(range(-(2**61), 2**61), 300)
    edges = {
        "path": list(zip(names[:60], names[1:61])),
        "star": [(max(names), x) for x in names],
        "random": [(draw.choice(names), draw.choice(names)) for _ in range(220)],
        "none": [],
    }[kind]
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    for most in (at.AT_ONCE, 0) if kind != "path" else (at.AT_ONCE,):
        assert {tuple(r) for r in at.components(table, most).collect()} == roots_of(edges)


def test_few_edges_take_few_jobs(spark):
    names = random.Random(3).sample(range(10**9), 41)
    spark.sparkContext.setJobGroup("few-edges", "")
    try:
        found = {tuple(r) for r in at.components(spark.createDataFrame(list(zip(names, names[1:])), "a bigint, b bigint")).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {(x, min(names)) for x in names} - {(min(names), min(names))}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")) <= 8
