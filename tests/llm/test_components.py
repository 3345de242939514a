"""Components of long chains, whose rounds were once bounded."""

import random

from provloom.llm.components import connected_components
from provloom.storage import Scratch


def test_long_chains_of_random_ids_are_one_component_each(spark):
    ids = [random.Random(k).sample(range(1000 * k, 1000 * k + 800), 800) for k in range(4)]
    links = spark.createDataFrame([(c[k], c[k + 1]) for c in ids for k in range(799)], "a long, b long").coalesce(2)
    scratch = Scratch(spark, "test-components")
    written = []
    keep = scratch.keep
    scratch.keep = lambda df, name, codec=None: (written.append(name), keep(df, name, codec))[1]
    got = {r["node"]: r["component"] for r in connected_components(scratch.keep(links, "links"), scratch).collect()}
    assert got == {i: 1000 * k for k, c in enumerate(ids) for i in c}
    assert sum(name.endswith("-heard") for name in written) < 20
    assert connected_components(scratch.keep(links.where("false"), "none"), scratch).collect() == []
