"""Runs, derivations and outputs: differences, producing runs, orphans, trace status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(entity_id, change) of outputs(entity_id, content_hash): added, removed, changed, unchanged."""
    left = a.select("entity_id", F.col("content_hash").alias("_a"))
    right = b.select("entity_id", F.col("content_hash").alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("unchanged")
    return left.join(right, "entity_id", "full_outer").select("entity_id", change.alias("change"))


def producing_run(outputs: DataFrame) -> DataFrame:
    """(entity_id, run_id): the current run that made an entity, else the greatest."""
    return outputs.groupBy("entity_id").agg(F.max_by("run_id", F.struct("is_current", "run_id")).alias("run_id"))


def orphans(references: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """References to what no row of the universe has."""
    return references.select(key).distinct().join(universe.select(key).distinct(), key, "left_anti")


def trace_status(entities: DataFrame, derived: DataFrame, spans: DataFrame) -> DataFrame:
    """(entity_id, status): COMPLETE with derivation and span, PARTIAL with one, MISSING with none; NOT_APPLICABLE if not material."""
    has = lambda df, name: df.select("entity_id").distinct().withColumn(name, F.lit(True))
    joined = entities.join(has(derived, "_d"), "entity_id", "left").join(has(spans, "_s"), "entity_id", "left")
    d, s = F.col("_d").isNotNull(), F.col("_s").isNotNull()
    status = F.when(~F.col("material"), "NOT_APPLICABLE").when(d & s, "COMPLETE").when(d | s, "PARTIAL").otherwise("MISSING")
    return joined.select("entity_id", status.alias("status"))


def _node(kind, ident):
    return F.concat(kind, F.lit("|"), ident)


def _input_nodes(column: str = "i"):
    kind = F.when(F.col(f"{column}.entity_type") == "source_file", "source_file").otherwise("entity")
    return _node(kind, F.col(f"{column}.entity_id"))


def backward_edges(derivations: DataFrame, runs: DataFrame) -> DataFrame:
    """(source, target) from what was made to what it was made of, nodes as ``kind|id``.

    derivations(id, run_id, inputs, outputs: arrays of (entity_type, entity_id), spans) and
    runs(id, source_hash).  Five kinds: entity to derivation, derivation to its inputs and
    spans, files and spans to the source identity of the runs that read them, and a source
    identity to every run that has it.
    """
    step = _node(F.lit("derivation"), F.col("id"))
    made = derivations.select(F.explode("outputs").alias("o"), step.alias("target")).select(_node(F.lit("entity"), F.col("o.entity_id")).alias("source"), "target")
    reads = derivations.select(step.alias("source"), F.explode("inputs").alias("i")).select("source", _input_nodes().alias("target"))
    cites = derivations.select(step.alias("source"), F.explode("spans").alias("span")).select("source", _node(F.lit("provenance_span"), F.col("span")).alias("target"))
    hashes = runs.select(F.col("id").alias("run_id"), _node(F.lit("source_identity"), F.col("source_hash")).alias("target"))
    files = derivations.select("run_id", F.explode("inputs").alias("i")).where("i.entity_type = 'source_file'").select("run_id", _input_nodes().alias("source"))
    spans = derivations.select("run_id", F.explode("spans").alias("span")).select("run_id", _node(F.lit("provenance_span"), F.col("span")).alias("source"))
    read_by = files.unionByName(spans).distinct().join(hashes, "run_id").select("source", "target")
    held = runs.select(_node(F.lit("source_identity"), F.col("source_hash")).alias("source"), _node(F.lit("run"), F.col("id")).alias("target"))
    return made.unionByName(reads).unionByName(cites).unionByName(read_by).unionByName(held).distinct()


def forward_edges(derivations: DataFrame) -> DataFrame:
    """(source, target): files and entities to the derivations that read them, these to what they made."""
    step = _node(F.lit("derivation"), F.col("id"))
    reads = derivations.select(F.explode("inputs").alias("i"), step.alias("target")).select(_input_nodes().alias("source"), "target")
    made = derivations.select(step.alias("source"), F.explode("outputs").alias("o")).select("source", _node(F.lit("entity"), F.col("o.entity_id")).alias("target"))
    return reads.unionByName(made).distinct()


def both_directions(backward: DataFrame, forward: DataFrame) -> DataFrame:
    """(root, node, direction, hop) of two walks (root, node, hop); what both meet counts backward."""
    b = backward.withColumn("direction", F.lit("backward"))
    f = forward.join(backward.select("root", "node"), ["root", "node"], "left_anti").withColumn("direction", F.lit("forward"))
    return b.unionByName(f).select("root", "node", "direction", "hop")


def spans_of_entities(derivations: DataFrame) -> DataFrame:
    """(entity_id, spans): the distinct spans that an entity's derivations cite, sorted."""
    rows = derivations.select(F.explode("outputs").alias("o"), "spans").select("o.entity_id", F.explode("spans").alias("span")).distinct()
    return rows.groupBy("entity_id").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def derivations_of_entities(derivations: DataFrame) -> DataFrame:
    """(entity_id, derivation): every derivation that made or read an entity or file, once."""
    refs = derivations.select(F.col("id").alias("derivation"), F.explode(F.concat("outputs", "inputs")).alias("r"))
    return refs.select("r.entity_id", "derivation").distinct()


def by_version(derivations: DataFrame, operation: str, version: str) -> DataFrame:
    return derivations.where((F.col("operation") == operation) & (F.col("operation_version") == version))


def hydrate(links: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owner and its records in the order of position, links without a record).

    links(owner, position, key), records(key, value).  A link that leads nowhere is an error
    for its owner, so it is returned as a violation instead of being left out in silence.
    """
    joined = links.join(records.select("key", "value", F.lit(True).alias("_there")), "key", "left")
    missing = joined.where("_there is null").select("owner", "position", "key")
    listed = F.array_sort(F.collect_list(F.struct("position", "value")))
    return joined.where("_there").groupBy("owner").agg(F.transform(listed, lambda x: x["value"]).alias("values")), missing
