"""Connected components of a link table, as joins and aggregates over distributed state.

Each round every node takes the smallest label among its own and its neighbours' labels,
passes it to the node that its label names (hooking), and then takes its label's own label
(pointer jumping), so whole regions join and rounds grow with the logarithm of a chain,
whatever the order of its ids.  Rounds go on until no label moves: labels only fall, so
they end, and then neighbours agree.  State is written to the shared folder after each
round.  Messages are aggregated before they are
shuffled, and both sides of each join are read from storage, so that Spark may split the
partition of a hub that most links touch.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.storage import Scratch, few


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long); component is the least node.

    ``links`` should be written already; the result is read from the scratch folder.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    edges = scratch.keep(edges.groupBy("low", "high").agg(F.lit(1).alias("one")).select("low", "high"), "cc-edges")
    many = 2 * edges.count()  # nodes at most
    ends = edges.select(F.col("high").alias("node"), F.col("low").alias("label")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("label")))
    labels = scratch.keep(few(ends.groupBy("node").agg(F.min("label").alias("label")), many), "cc-0")
    for k in count(1):
        by_low = edges.join(labels.withColumnRenamed("node", "low"), "low").select(F.col("high").alias("node"), "label")
        by_high = edges.join(labels.withColumnRenamed("node", "high"), "high").select(F.col("low").alias("node"), "label")
        own = labels.withColumn("own", F.col("label"))
        heard = own.unionByName(by_low, allowMissingColumns=True).unionByName(by_high, allowMissingColumns=True)
        heard = scratch.keep(few(heard.groupBy("node").agg(F.min("label").alias("label"), F.max("own").alias("own")), many), f"cc-{k}-heard")
        hooks = heard.where("label < own").select(F.col("own").alias("node"), "label")
        hooked = scratch.keep(few(heard.select("node", "label").unionByName(hooks).groupBy("node").agg(F.min("label").alias("label")), many), f"cc-{k}-hooked")
        roots = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = hooked.join(roots, "label").select("node", F.col("root").alias("label"))
        new = scratch.keep(few(jumped, many), f"cc-{k}")
        moved = new.alias("n").join(labels.alias("o"), "node").where("n.label <> o.label").limit(1).count()
        scratch.drop(f"cc-{k}-heard", f"cc-{k}-hooked", f"cc-{k - 1}")
        labels = new
        if not moved:
            break
    scratch.drop("cc-edges")
    return labels.withColumnRenamed("label", "component")
