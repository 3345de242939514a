"""Resolution joins: calls, storage, types by name, families by signature sets, spans in spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provloom.storage import Scratch


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order that must be total within the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def resolve_calls(sites: DataFrame, declared: DataFrame, scope: DataFrame) -> DataFrame:
    """Adds ``outcome`` to call sites (contract, signature): resolved, unresolved or outside.

    A site is resolved if its contract declares the signature, unresolved if the contract
    is in scope and does not, outside if the contract is unknown.
    """
    inside = scope.select("contract").distinct()
    targets = declared.select("contract", "signature").distinct().join(inside, "contract", "left_semi").withColumn("_declared", F.lit(True))
    found = sites.join(targets, ["contract", "signature"], "left").join(inside.withColumn("_inside", F.lit(True)), "contract", "left")
    outcome = F.when(F.col("_declared"), "resolved").when(F.col("_inside"), "unresolved").otherwise("outside")
    return found.withColumn("outcome", outcome).drop("_declared", "_inside")


def expand_access(access: DataFrame) -> DataFrame:
    """One row per edge: ``readwrite`` becomes a READS and a WRITES."""
    kinds = F.when(F.col("op") == "readwrite", F.array(F.lit("READS"), F.lit("WRITES"))).when(F.col("op") == "read", F.array(F.lit("READS"))).otherwise(F.array(F.lit("WRITES")))
    return access.withColumn("type", F.explode(kinds)).drop("op")


def inheritance(bases: DataFrame, contracts: DataFrame) -> DataFrame:
    """(source, target, type): IMPLEMENTS for interfaces, INHERITS for others, MISSING if unknown; self left out."""
    known = contracts.select(F.col("contract").alias("target"), F.col("kind").alias("_kind"))
    kind = F.when(F.col("_kind").isNull(), "MISSING").when(F.col("_kind") == "interface", "IMPLEMENTS").otherwise("INHERITS")
    return bases.where("source <> target").join(known, "target", "left").select("source", "target", kind.alias("type"))


def unique_by_name(named: DataFrame, name: str) -> DataFrame:
    """Adds ``matches``, how many rows share the name, and ``unique``."""
    counts = named.groupBy(name).agg(F.count("*").alias("matches"))
    return named.join(counts, name).withColumn("unique", F.col("matches") == 1)


def pin_hits(signatures: DataFrame, pins: DataFrame) -> DataFrame:
    """(contract, families): the families all of whose pins a contract has, in one aggregation.

    ``pins`` is a recognition list; one row per family comes to the driver.
    """
    sizes = {r["family"]: r["n"] for r in pins.groupBy("family").agg(F.count_distinct("signature").alias("n")).orderBy("family").collect()}
    hit = F.when(F.col("family").isNotNull(), F.struct("family", "signature"))
    held = signatures.select("contract", "signature").join(pins.select("family", "signature").distinct(), "signature", "left").groupBy("contract").agg(F.collect_set(hit).alias("_hits"))
    def whole(family: str, size: int):
        return F.when(F.size(F.filter("_hits", lambda hit: hit["family"] == F.lit(family))) == size, F.lit(family))

    found = F.array(*[whole(family, size) for family, size in sizes.items()]).cast("array<string>")
    return held.select("contract", F.filter(found, lambda f: f.isNotNull()).alias("families"))


def family_of(signatures: DataFrame, pins: DataFrame) -> DataFrame:
    """(contract, family): the one family all of whose pins the contract has; ``unknown`` for none or several."""
    return pin_hits(signatures, pins).select("contract", F.when(F.size("families") == 1, F.element_at("families", 1)).otherwise("unknown").alias("family"))


def in_one_container(issues: DataFrame, containers: DataFrame) -> DataFrame:
    """Issues (issue, file, line_start, line_end) with how many spans of the file hold them, and the one if single."""
    spans = containers.select(F.col("file"), F.col("line_start").alias("_s"), F.col("line_end").alias("_e"), F.col("id").alias("_id"))
    held = issues.join(spans, "file").where("_s <= line_start and line_end <= _e").groupBy("issue").agg(F.count("*").alias("n"), F.min("_id").alias("container"))
    return issues.select("issue").join(held, "issue", "left").select("issue", F.coalesce("n", F.lit(0)).alias("containers"), F.when(F.col("n") == 1, F.col("container")).alias("container"))


#: Least orders of up to this many keys are broadcast; more are joined as Spark chooses.
FEW_KEYS = 1_000_000


def first_link(links: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the value of the least ``order`` of each key, the least value where several have it.

    The least orders are found first, links then meet them, and few are left to choose from: with an
    ``order`` of fixed width (a number) no task sorts links or keeps more of them than it has keys.
    A null order counts only where a key has no other.
    """
    least = Scratch(links.sparkSession, "first-link").keep(links.groupBy(key).agg(F.min(order).alias("_least")), "least")
    least = least.select(F.col(key).alias("_key"), "_least")
    least = F.broadcast(least) if least.count() <= FEW_KEYS else least
    met = links.join(least, F.col(key).eqNullSafe(F.col("_key")) & F.col(order).eqNullSafe(F.col("_least")))
    return met.groupBy(key).agg(F.min(value).alias(value))


def data_influence(accesses: DataFrame, calls: DataFrame) -> DataFrame:
    """(location, writer, reader) where the writer calls the reader and both touch the location."""
    writes = accesses.where("writes").select("location", F.col("function").alias("writer")).distinct()
    reads = accesses.where("reads").select("location", F.col("function").alias("reader")).distinct()
    edges = calls.select(F.col("source").alias("writer"), F.col("target").alias("reader")).where("writer <> reader").distinct()
    return edges.join(writes, "writer").join(reads, ["reader", "location"]).select("location", "writer", "reader")


def call_influence(calls: DataFrame, effects: DataFrame) -> DataFrame:
    """(source, target, effects): how many effects a callee has; 0 is an unknown."""
    many = effects.groupBy(F.col("function").alias("target")).agg(F.count("*").alias("effects"))
    return calls.select("source", "target").distinct().join(many, "target", "left").select("source", "target", F.coalesce("effects", F.lit(0)).alias("effects"))
