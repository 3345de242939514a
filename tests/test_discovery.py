"""Discovery order against a plain queue."""

import random
from collections import deque

import pytest

from provloom.operators import graph

SCHEMA = "source string, target string, type string, seq int"


def plain(edges, root, bound):
    children = {}
    for source, target, kind, seq in edges:
        if source is not None and target is not None:
            children.setdefault(source, []).append(((kind is not None, kind or "", seq is not None, seq or 0), target.encode("utf-16-be"), target))
    rows, met, queue, cut = [], {root}, deque([(root, 0)]), False
    while queue:
        node, hop = queue.popleft()
        rows.append((root, node, hop, len(rows) + 1))
        for _, _, child in sorted(children.get(node, [])):
            if child in met:
                continue
            if bound is not None and hop >= bound:
                cut = True
                continue
            met.add(child)
            queue.append((child, hop + 1))
    return rows, cut


@pytest.mark.parametrize("seed, bound", [(1, None), (2, 2), (3, 0), (4, 3)])
def test_equals_a_queue(spark, seed, bound):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(30)] + ["\uffee", "\U0001f600", ""]
    edges = [(r.choice(names), r.choice(names), r.choice(["A", "B", None]), r.choice([1, 2, None])) for _ in range(90)]
    edges += edges[:10] + [("n1", "n1", "A", 1), (None, "n2", "A", 1), ("n2", None, "A", 1)]  # repeats, a loop, null ends
    edges += [("hub", n, "A", 1) for n in names]  # all children tie
    roots = ["n0", "n1", "n1", "hub", "alone", None]
    found, flags = graph.discovered(spark.createDataFrame(edges, SCHEMA), spark.createDataFrame([(x,) for x in roots], "root string"), bound, ["type", "seq"])
    wanted, cut = [], {}
    for root in {x for x in roots if x is not None}:
        rows, cut[root] = plain(edges, root, bound)
        wanted += rows
    assert sorted(map(tuple, found.select("root", "node", "hop", "place").collect())) == sorted(wanted)
    assert {row["root"]: row["truncated"] for row in flags.collect()} == cut


def test_nothing_to_walk(spark):
    edges = spark.createDataFrame([], SCHEMA)
    found, flags = graph.discovered(edges, spark.createDataFrame([], "root string"), 3, ["type"])
    assert found.isEmpty() and flags.isEmpty()


def test_least_parents_are_found_without_sorts(spark, monkeypatch):
    plans, real = [], graph.numbered

    def seen(rows, *more):
        plans.append(rows._jdf.queryExecution().toString())
        return real(rows, *more)

    monkeypatch.setattr(graph, "numbered", seen)
    edges = spark.createDataFrame([("a", "c", "Y", 1), ("a", "b", "Y", 1), ("a", "c", "X", 1)], SCHEMA)
    found, _ = graph.discovered(edges, spark.createDataFrame([("a",)], "root string"), 2, ["type"])
    assert sorted((r["place"], r["node"]) for r in found.collect()) == [(1, "a"), (2, "c"), (3, "b")]
    assert plans and not any("SortAggregate" in p for p in plans)
