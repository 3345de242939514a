"""Traversals as frontier joins: bounded breadth-first search, closure, contexts, paths, cycles.

Every step joins the frontier with the edges, drops what was visited by an anti join and
writes the new frontier to the shared folder, so plans stay short and executors can be
lost.  Many roots travel together: state is keyed by root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provloom.operators.order import code_units, numbered
from provloom.storage import Scratch, buckets_for


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None, with_roots: bool = True) -> DataFrame:
    """(root, node, hop): the least number of steps from each root along source → target.

    ``max_depth`` None walks until nothing new is met; depth 0 or less leaves the roots.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    steps = scratch.keep(edges.select("source", "target").where("source <> target").distinct(), "edges")
    frontier = scratch.keep(roots.select(F.col("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("hop")), "hop-0")
    seen, hop = frontier, 0
    while max_depth is None or hop < max_depth:
        hop += 1
        step = frontier.join(steps, frontier["node"] == steps["source"]).select("root", F.col("target").alias("node")).distinct()
        frontier = scratch.keep(step.join(seen, ["root", "node"], "left_anti").withColumn("hop", F.lit(hop)), f"hop-{hop}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    scratch.drop("edges")
    return seen if with_roots else seen.where("node <> root")


#: A frontier of more rows than this is joined as Spark chooses; a smaller one is broadcast.
SMALL_FRONTIER = 200_000


def related_entities(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, hop) of what is within ``depth`` undirected steps; roots excluded.

    Each step looks the frontier up at both ends of the edges, which are neither turned
    around nor made distinct as a whole; only what a step finds is.
    """
    scratch = Scratch(edges.sparkSession, "related")
    frontier = scratch.keep(roots.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("hop")), "hop-0")
    seen = frontier
    for hop in range(1, max(0, depth) + 1):
        near = frontier.select("root", F.col("node").alias("at"))
        near = F.broadcast(near) if frontier.count() <= SMALL_FRONTIER else near
        out = edges.join(near, F.col("source") == F.col("at")).select("root", F.col("target").alias("node"))
        back = edges.join(near, F.col("target") == F.col("at")).select("root", F.col("source").alias("node"))
        found = out.unionByName(back).distinct().join(seen, ["root", "node"], "left_anti")
        frontier = scratch.keep(found.withColumn("hop", F.lit(hop)), f"hop-{hop}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("node <> root")


def transitive_closure(edges: DataFrame) -> DataFrame:
    """(source, target) of all pairs that a path joins, the trivial ones left out.

    Paths are doubled: a round joins what the last one found with all pairs known, so rounds
    grow with the logarithm of the longest path.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    fresh = scratch.keep(edges.select("source", "target").where("source <> target").distinct(), "pairs-0")
    known, k = fresh, 0
    while not fresh.isEmpty():
        k += 1
        ahead = fresh.select("source", F.col("target").alias("via")).join(known.select(F.col("source").alias("via"), "target"), "via")
        behind = known.select("source", F.col("target").alias("via")).join(fresh.select(F.col("source").alias("via"), "target"), "via")
        found = ahead.unionByName(behind).select("source", "target").where("source <> target").distinct()
        fresh = scratch.keep(found.join(known, ["source", "target"], "left_anti"), f"pairs-{k}")
        known = known.unionByName(fresh)
    return known


def leading_to(edges: DataFrame, ends: DataFrame, rounds: int = 4) -> DataFrame:
    """Edges (source, target) without most of those that lead to none of ``ends``(id), dead ends being taken away ``rounds`` times at most.

    All ways to the ends stay whole; some other edges, that lead on for longer or to a cycle, may stay too.
    """
    scratch = Scratch(edges.sparkSession, "leading")
    left = scratch.keep(edges.select("source", "target"), "left-0")
    before, ends = left.count(), scratch.keep(ends.select("id").distinct(), "ends")
    for k in range(1, rounds + 1):
        goals = left.select(F.col("source").alias("target")).unionByName(ends.select(F.col("id").alias("target")))
        left = scratch.keep(left.join(goals, "target", "left_semi").select("source", "target"), f"left-{k}")
        after = left.count()
        if after in (0, before):
            break
        before = after
    return left


def _cut_off(found: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, truncated): whether an unvisited node lies one step beyond the bound.

    One such node settles a root, so a small part of the edge is asked first, and the rest for those roots only that it leaves open.
    """
    scratch = Scratch(edges.sparkSession, "cut-off")
    steps = edges.select("source", "target")
    edge = found.where(F.col("hop") == max_depth).select("root", "node")
    part = F.pmod(F.xxhash64("node"), F.lit(64)) == 0

    def settled(at: DataFrame) -> DataFrame:
        beyond = at.join(steps, F.col("node") == F.col("source")).select("root", F.col("target").alias("node")).distinct()
        return beyond.join(found, ["root", "node"], "left_anti").select("root").distinct()

    early = scratch.keep(settled(edge.where(part)), "early")
    done = F.broadcast(early) if early.count() <= SMALL_FRONTIER else early
    more = early.unionByName(settled(edge.where(~part).join(done, "root", "left_anti"))).withColumn("truncated", F.lit(True))
    return roots.select("root").distinct().join(more, "root", "left").select("root", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def traced(edges: DataFrame, roots: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """``reach`` and, per root, whether an unvisited node lies beyond the bound."""
    found = reach(edges, roots, max_depth)
    return found, _cut_off(found, edges, roots, max_depth)


def discovered(edges: DataFrame, roots: DataFrame, max_depth: int | None, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(root, node, hop, place) in the order in which a queue would meet the nodes, and (root, truncated).

    The root has place 1.  A node is met from the first of its parents by place, at its least
    place among that parent's children; children come in the order of the columns ``order``
    of the edges, then of their names by code units.  Each step numbers what it found over range
    partitions, so that neither a hub nor a level need fit into a task.  Edges of null
    ends lead nowhere; repeated edges and loops change nothing; ``max_depth`` None walks to the end.
    """
    scratch = Scratch(edges.sparkSession, "discovered")
    ways = edges.where("source <> target").select("source", "target", *order)
    # Edges are moved once, into buckets by source, and are made distinct there.
    # Of an edge's order only its rank among those of its source is kept, so that parent and rank make one number, whose least needs no sort.
    rank = F.dense_rank().over(Window.partitionBy("source").orderBy(*order)) if order else F.lit(1)
    least = lambda spread: spread.distinct().withColumn("_rank", rank).groupBy("source", "target").agg(F.min("_rank").alias("_rank"))
    steps = scratch.keep_bucketed(ways, "edges", int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", each=least)
    ranks = (steps.agg(F.max("_rank")).first()[0] or 0) + 1
    frontier = scratch.keep(roots.select("root").where("root is not null").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("hop"), F.lit(1).cast("long").alias("place")), "hop-0")
    seen, hop = frontier, 0
    while max_depth is None or hop < max_depth:
        hop += 1
        near = frontier.join(steps, frontier["node"] == steps["source"]).select("root", F.col("target").alias("node"), (F.col("place") * ranks + F.col("_rank")).alias("at"))
        fresh = near.groupBy("root", "node").agg(F.min("at").alias("at")).join(seen, ["root", "node"], "left_anti")
        level = numbered(fresh.select("root", "node", "at"), ["root"], [F.col("at"), code_units(F.col("node"))], "place", scratch, f"level-{hop}")
        met = seen.groupBy("root").agg(F.max("place").alias("met"))
        placed = level.join(met, "root").select("root", "node", F.lit(hop).alias("hop"), (F.col("place") + F.col("met")).alias("place"))
        frontier = scratch.keep(placed, f"hop-{hop}")
        scratch.drop(f"level-{hop}-sorted", f"level-{hop}-firsts")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen, _cut_off(seen, steps, roots.where("root is not null"), hop if max_depth is None else max_depth)


def contexts(edges: DataFrame, entries: DataFrame, max_depth: int | None = None, step: str = "id") -> DataFrame:
    """(root, node, hop, chain): the shortest call chain from each entry to each target, however long.

    ``step`` is the column of an edge that chains are made of; it must tell edges apart and
    order them.  Of equally short chains the least is kept: parents in the order of their own
    chains, then edges, as a breadth-first walk that takes edges in order would.
    ``max_depth`` bounds the walk where the caller wants less.
    """
    scratch = Scratch(edges.sparkSession, "contexts")
    pair = ["root", "node"]
    buckets = buckets_for(edges.count() + entries.count())
    steps = scratch.keep_bucketed(edges.select(F.col(step).alias("_step"), "source", "target"), "edges", buckets, "source")
    kind = dict(steps.dtypes)["_step"]
    start = entries.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("hop"), F.array().cast(f"array<{kind}>").alias("chain"))
    seen, hop = scratch.keep_bucketed(start, "seen", buckets, *pair), 0
    while max_depth is None or hop < max_depth:
        frontier = seen.where(F.col("hop") == hop)
        hop += 1
        # Edges and what was met lie in buckets: a step moves its own rows only, by node and then by pair.
        near = frontier.join(steps, frontier["node"] == steps["source"]).select("root", F.col("target").alias("node"), F.array_append("chain", F.col("_step")).alias("chain"))
        best = near.repartition(buckets, *pair).groupBy(*pair).agg(F.min("chain").alias("chain"))
        fresh = best.join(seen.select(*pair), pair, "left_anti").select(*pair, F.lit(hop).alias("hop"), "chain")
        seen = scratch.append_bucketed(fresh, "seen", buckets, *pair)
        if seen.where(F.col("hop") == hop).isEmpty():
            break
    scratch.drop("edges")
    return seen


def simple_paths(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, path): every path without a repeated node, of one edge at least, up to the bound."""
    scratch = Scratch(edges.sparkSession, "paths")
    steps = scratch.keep(edges.select("source", "target").distinct(), "edges")
    frontier = roots.select("root", F.col("root").alias("node"), F.array("root").alias("path"))
    found = None
    for hop in range(1, max_depth + 1):
        step = frontier.join(steps, frontier["node"] == steps["source"]).where(~F.array_contains("path", F.col("target")))
        frontier = scratch.keep(step.select("root", F.col("target").alias("node"), F.array_append("path", F.col("target")).alias("path")), f"hop-{hop}")
        if frontier.isEmpty():
            break
        found = frontier if found is None else found.unionByName(frontier)
    scratch.drop("edges")
    return (frontier if found is None else found).select("root", "path")


def cycle_residue(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges left when nodes without outgoing edges are taken away again and again: empty if acyclic.

    After ``rounds``, where given, what still stands leads at least so far.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    left = scratch.keep(edges.select("source", "target").distinct(), "left-0")
    before, k = left.count(), 0
    while before and (rounds is None or k < rounds):
        k += 1
        inner = left.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")
        left = scratch.keep(inner, f"left-{k}")
        scratch.drop(f"left-{k - 1}")
        after = left.count()
        if after == before:
            break
        before = after
    return left
