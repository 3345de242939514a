"""Influence records, run stages and status, meta values, and artifacts as canonical lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provloom.functions.canonical import canonical_json, content_id
from provloom.operators.order import sorted_by_units
from provloom.storage import Scratch, buckets_for, release_shuffles

#: The stage in which each error code arises; all others arise in analysis.
STAGES = {"NoSourcesFound": "discover", "SourceLimitExceeded": "discover", "RootEscape": "discover", "CompilationFailed": "compile", "CompilerUnavailable": "compile"}


def state_version(location: Column, function: Column) -> Column:
    return F.concat(F.lit("state-version:"), location, F.lit("@"), function)


def attributed_accesses(relationships: DataFrame, functions: DataFrame) -> DataFrame:
    """(location, file, line_start, line_end, function, write_ids, read_ids): each access once for every function that takes part in it.

    An access is all READS and WRITES of one location in one span; its ids are all of theirs,
    whichever function they come from.
    """
    known = relationships.where("type in ('READS', 'WRITES')").join(functions.select(F.col("id").alias("source")), "source", "left_semi")
    ids = lambda kind: sorted_by_units(F.collect_set(F.when(F.col("type") == kind, F.col("id")))).alias(f"{kind.lower()[:-1]}_ids")
    span = ["file", "line_start", "line_end"]
    # An access has no more functions than edges: they are gathered beside its ids and come apart in place.
    whole = known.groupBy(F.col("target").alias("location"), *span).agg(F.collect_set("source").alias("_functions"), ids("WRITES"), ids("READS"))
    return whole.select("location", *span, F.explode("_functions").alias("function"), "write_ids", "read_ids")


def influences(accesses: DataFrame, conditions: DataFrame, calls: DataFrame, rows: int = 0) -> DataFrame:
    """(id, kind, from_ref, to_ref, evidence, basis) of data, control and call influence.

    accesses from ``attributed_accesses``, conditions(id, function, basis), calls(id, source,
    target) between known functions.  Data flows where a function of an access that writes a
    location calls one of an access that reads it; the evidence is that of these two accesses.
    Accesses are written once, in buckets by function, where calls and conditions come to them and
    equal records meet; names of functions hold no ``@``.  ``rows`` bounds the accesses where the caller
    knows it: buckets then grow in number and not in size, so that their sorts need not spill.
    """
    spark = accesses.sparkSession
    buckets = max(buckets_for(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = accesses.select(F.col("function").alias("target"), "location", "write_ids", "read_ids")
    own = Scratch(spark, "influences").keep_bucketed(held, "own", buckets, "target").withColumn("effect_ids", F.concat("write_ids", "read_ids"))
    release_shuffles(spark)  # what gathered the accesses is not read again
    writers = own.where("size(write_ids) > 0").select(F.col("target").alias("source"), "location", F.col("write_ids").alias("evidence"))
    readers = own.where("size(read_ids) > 0").join(calls.where("source <> target").select("target"), "target", "left_semi").select("target", "location", "read_ids")
    data = calls.where("source <> target").join(writers, "source").join(readers, ["target", "location"])
    data = data.select("target", F.lit("data-supported").alias("kind"), state_version(F.col("location"), F.col("source")).alias("from_ref"), state_version(F.col("location"), F.col("target")).alias("to_ref"), F.concat("evidence", "read_ids", F.array("id")).alias("evidence"), F.array("location", "source", "target").alias("more"))
    control = conditions.select("id", F.col("function").alias("target"), F.col("basis").alias("held")).join(own, "target")
    control = control.select("target", F.lit("control-supported").alias("kind"), F.concat(F.lit("gate:"), "id").alias("from_ref"), state_version(F.col("location"), F.col("target")).alias("to_ref"), F.concat(F.array("id"), "effect_ids").alias("evidence"), F.concat("effect_ids", "held", F.array("location")).alias("more"))
    called = calls.join(own, "target")
    called = called.select("target", F.lit("call-supported").alias("kind"), F.concat(F.lit("call-site:"), "id").alias("from_ref"), state_version(F.col("location"), F.col("target")).alias("to_ref"), F.concat(F.array("id"), "effect_ids").alias("evidence"), F.array("location", "source", "target").alias("more"))
    # The condition itself is evidence of a control influence, no basis of it.
    basis = F.when(F.col("kind") == "control-supported", F.col("more")).otherwise(F.concat("evidence", "more"))
    ident = content_id("seme", **{"kind": F.col("kind"), "from": F.col("from_ref"), "to": F.col("to_ref"), "evidence": F.col("evidence")})

    def made(rows: DataFrame) -> DataFrame:
        listed = rows.select("target", "kind", "from_ref", "to_ref", sorted_by_units(F.col("evidence")).alias("evidence"), sorted_by_units(basis).alias("basis"))
        return listed.select("target", ident.alias("id"), "kind", "from_ref", "to_ref", "evidence", "basis").dropDuplicates(["target", "id"]).drop("target")

    return made(data).unionByName(made(control)).unionByName(made(called))


def silent_calls(calls: DataFrame, accesses: DataFrame) -> DataFrame:
    """Unknown drafts (scope, reason, basis) of calls whose callee touches nothing known."""
    lost = calls.join(accesses.select(F.col("function").alias("target")).distinct(), "target", "left_anti")
    return lost.select(F.lit("influence-arg-param").alias("scope"), F.lit("no_evidence").alias("reason"), F.array("id").alias("basis"))


def stage_of(code: Column) -> Column:
    return F.coalesce(*[F.when(code == c, F.lit(stage)) for c, stage in STAGES.items()], F.lit("analysis"))


def message_without_code(code: Column, message: Column) -> Column:
    """The message without ``[code] `` before it."""
    prefix = F.concat(F.lit("["), code, F.lit("] "))
    return F.when(F.startswith(message, prefix), F.substr(message, F.length(prefix) + 1)).otherwise(message)


def model_status(entries: DataFrame, syntactic: bool, failed: bool = False) -> DataFrame:
    """(status, degradation): FAILED, or PARTIAL if the fidelity or any entry degrades the model, else COMPLETE."""
    part = F.when(F.col("status") == "UNRESOLVED", F.concat(F.lit("unresolved:"), "path")).when(F.col("status") == "UNSUPPORTED", F.concat(F.lit("unsupported:"), "path"))
    listed = entries.select(part.alias("part")).where("part is not null").distinct()
    counted = listed.agg(F.count("*").alias("n"))
    status = F.lit("FAILED") if failed else F.when((F.col("n") > 0) | F.lit(syntactic), "PARTIAL").otherwise("COMPLETE")
    return counted.select(status.alias("status"), (F.col("n") + int(syntactic)).alias("degradation"))


def latest_meta(stored: DataFrame, patches: DataFrame) -> DataFrame:
    """(key, value): the value of the last patch(key, value, seq) of each key, else what is stored."""
    last = patches.groupBy("key").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))
    return last.unionByName(stored.select("key", "value").join(last.select("key"), "key", "left_anti"))


def canonical_lines(tables: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """(kind, id, json): every record of an artifact as canonical JSON; by kind and id this is its text."""
    made = [df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), canonical_json(**{c: F.col(c) for c in df.columns}).alias("json")) for kind, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, made)


def unknown_keys(rows: DataFrame, key: str, json: str, known: list[str]) -> DataFrame:
    """(key, extra): JSON objects with keys that the schema does not have, or that are no objects."""
    keys = F.json_object_keys(json)
    extra = F.coalesce(F.array_except(keys, F.array(*map(F.lit, known))), F.array(F.lit("<malformed>")))
    return rows.select(key, F.array_sort(extra).alias("extra")).where(F.size("extra") > 0)
