"""Semantic layers over stored evidence: state transitions and authority chains.

Inputs are tables: functions(id, contract_id, name, mutability, modifiers, file),
relationships(id, type, source, target, call_kind, file, line_start, line_end),
facts(id, subject, predicate, value, file, line_start, line_end), issues(file, code) and
states(id, type).  Nothing is guessed: what evidence cannot show is a row of unknowns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provloom.functions.canonical import content_id

#: Kinds a call may have, and those that a fact's marker stands for.
CALL_KINDS = ["internal", "external", "super", "self-external", "lowlevel", "delegatecall", "staticcall", "new", "indirect"]
MARKERS = {"unresolved-lowlevel-call": "lowlevel", "unresolved-delegatecall": "delegatecall", "unresolved-staticcall": "staticcall", "unresolved-indirect-call": "indirect"}
#: The storage types by which a role is known.
ROLE_STORAGE = {"owner": "IOwnable", "admin": "IAdmin", "governance": "IGovernance"}

EMPTY = "cast(array() as array<string>)"


def _sorted_set(value: Column) -> Column:
    return F.array_sort(F.collect_set(value))


def _span(name: str) -> Column:
    return F.struct("file", "line_start", "line_end", F.col(name).alias("tie"))


def _file_flags(issues: DataFrame) -> DataFrame:
    has = lambda code: F.bool_or(F.col("code") == code)
    return issues.groupBy("file").agg(
        has("compilation_failed").alias("dropped"), has("unsupported_assembly").alias("assembly"), has("call_target_unresolved").alias("unresolved"), has("call_target_outside_source_set").alias("outside"))


def state_transitions(functions: DataFrame, relationships: DataFrame, facts: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transitions, unknowns): one transition per function whose file compiled.

    Effects (calls, then markers) and observations (emitted events) stand in source order.
    """
    known = functions.select(F.col("id").alias("target"), F.lit(True).alias("_known"))
    # Edges of unknown sources fall away where functions take in their groups; only calls ask who their target is.
    columns = ["id", "type", "source", "target", "call_kind", "file", "line_start", "line_end"]
    edges = relationships.select(*columns)
    calls = edges.where("type = 'CALLS'").join(known, "target", "left").select(*columns, "_known")
    others = edges.where("not (type <=> 'CALLS')").select("id", "type", "source", "target", *[F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in columns[4:]], F.lit(None).cast("boolean").alias("_known"))
    outgoing = calls.unionByName(others)
    kind = F.when(F.col("call_kind").isin(CALL_KINDS), F.col("call_kind"))
    effect = F.struct(_span("id").alias("at"), kind.alias("call_kind"), F.when(F.col("_known"), F.col("target")).alias("target_ref"), F.when(F.col("_known"), "E1").otherwise("E3").alias("evidence"), F.col("id").alias("basis"))
    is_call = F.col("type") == "CALLS"
    by_edge = outgoing.groupBy(F.col("source").alias("id")).agg(
        _sorted_set(F.when(F.col("type") == "READS", F.col("target"))).alias("reads"), _sorted_set(F.when(F.col("type") == "WRITES", F.col("target"))).alias("writes"),
        F.collect_list(F.when(is_call & kind.isNotNull(), effect)).alias("calls"), F.collect_set("id").alias("edge_ids"),
        _sorted_set(F.when(is_call & kind.isNull(), F.col("id"))).alias("kindless"), _sorted_set(F.when(is_call & kind.isNotNull() & F.col("_known").isNull(), F.col("id"))).alias("outward"))
    marker = F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair])[F.col("value")]
    marked = F.col("predicate").isin("CALLS", "DELEGATES_TO") & marker.isNotNull()
    mark = F.struct(_span("id").alias("at"), marker.alias("call_kind"), F.lit(None).cast("string").alias("target_ref"), F.lit("E3").alias("evidence"), F.col("id").alias("basis"))
    by_fact = facts.groupBy(F.col("subject").alias("id")).agg(
        F.collect_list(F.when(marked, mark)).alias("marks"), F.collect_list(F.when(F.col("predicate") == "EMITS", _span("id"))).alias("events"),
        F.collect_set("id").alias("fact_ids"), _sorted_set(F.when(marked, F.col("id"))).alias("marker_ids"))
    rows = functions.join(_file_flags(issues), "file", "left").join(by_edge, "id", "left").join(by_fact, "id", "left")
    rows = rows.withColumn("record", content_id("semt", function_id=F.col("id"), contract_id=F.col("contract_id")))
    none = F.expr(EMPTY)
    got = lambda c: F.coalesce(c, none)
    effects = F.array_sort(F.concat(F.coalesce("calls", F.array()), F.coalesce("marks", F.array())))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    alive = rows.where(~flag("dropped"))
    made = alive.select(
        F.col("record").alias("id"), F.col("id").alias("function_id"), "contract_id", got("reads").alias("reads"), got("writes").alias("writes"), F.array_intersect(got("writes"), got("reads")).alias("readwrite"),
        F.transform(effects, lambda e: F.struct(e["call_kind"].alias("call_kind"), e["target_ref"].alias("target_ref"), e["evidence"].alias("evidence"), e["basis"].alias("basis"))).alias("external_effects"),
        F.when(F.col("mutability") == "payable", "payable").otherwise("nonpayable").alias("value_handling"),
        F.transform(F.array_sort(F.coalesce("events", F.array())), lambda e: e["tie"]).alias("observations"),
        F.when(F.size(got("writes")) > 0, "storage").otherwise("none").alias("state_mutation"), F.when(flag("assembly"), F.array(F.lit("assembly_skipped"))).otherwise(none).alias("fidelity_flags"),
        F.array_sort(F.concat(F.array("id"), got("edge_ids"), got("fact_ids"))).alias("basis"))
    own = F.array("id")
    if_any = lambda ids_: F.when(F.size(ids_) > 0, ids_)
    draft = lambda field, reason, basis: F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), basis.alias("basis"))
    outward = F.array_sort(F.array_distinct(F.concat(got("outward"), F.when(flag("outside"), own).otherwise(none))))
    unresolved = F.array_sort(F.array_distinct(F.concat(got("marker_ids"), F.when(flag("unresolved"), own).otherwise(none))))
    drafts = F.array(
        draft("fidelity_flags", "unsupported_assembly", F.when(flag("assembly"), own)), draft("external_effects", "no_evidence", if_any(got("kindless"))),
        draft("external_effects", "out_of_scope_target", if_any(outward)), draft("external_effects", "unresolved_call", if_any(unresolved)))
    unknowns = alive.select(F.col("record").alias("record_ref"), F.explode(F.filter(drafts, lambda x: x["basis"].isNotNull())).alias("u")).select("record_ref", "u.*")
    lost = rows.where(flag("dropped")).select(F.col("id").alias("record_ref"), F.lit("transition").alias("field"), F.lit("dropped_file").alias("reason"), F.array("id").alias("basis"))
    return made, unknowns.unionByName(lost)


def file_unknowns(functions: DataFrame, issues: DataFrame) -> DataFrame:
    """Of the unknowns of ``state_transitions`` those that follow from a function's file alone: skipped assembly and dropped files."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = functions.join(_file_flags(issues), "file", "left")
    record = content_id("semt", function_id=F.col("id"), contract_id=F.col("contract_id"))
    draft = lambda ref, field, reason: [ref.alias("record_ref"), F.lit(field).alias("field"), F.lit(reason).alias("reason"), F.array("id").alias("basis")]
    skipped = rows.where(flag("assembly") & ~flag("dropped")).select(*draft(record, "fidelity_flags", "unsupported_assembly"))
    return skipped.unionByName(rows.where(flag("dropped")).select(*draft(F.col("id"), "transition", "dropped_file")))


def authority_chains(functions: DataFrame, relationships: DataFrame, states: DataFrame, transitions: DataFrame) -> DataFrame:
    """One chain per function: who calls it, under what role, through what gate, to what effect.

    The actor is the source of the incoming call of least id; a role is known by the type of
    storage that the function touches, never by a modifier's name.
    """
    callers = functions.select(F.col("id").alias("source"))
    actors = relationships.where("type = 'CALLS'").join(callers, "source", "left_semi").groupBy(F.col("target").alias("id")).agg(F.min_by("source", "id").alias("actor"))
    role = F.coalesce(*[F.when(F.array_contains("types", t), F.lit(r)) for r, t in ROLE_STORAGE.items()])
    typed = states.where(F.col("type").isin(list(ROLE_STORAGE.values()))).select(F.col("id").alias("target"), F.col("type").alias("state_type"))
    touched = relationships.where("type in ('READS', 'WRITES')").join(typed, "target")
    roles = touched.groupBy(F.col("source").alias("id")).agg(F.collect_set("state_type").alias("types"), F.min_by("target", F.when(F.col("type") == "WRITES", F.col("id"))).alias("_first"), F.bool_or(F.col("type") == "WRITES").alias("_writes"))
    roles = roles.select("id", role.alias("kind"), F.when(F.col("_writes"), F.col("_first")).alias("subject"))
    moved = transitions.select(F.col("function_id").alias("id"), F.when(F.size("fidelity_flags") == 0, F.col("id")).alias("transition_id"), F.array_min(F.transform("external_effects", lambda e: e["call_kind"])).alias("impact"))
    rows = functions.join(actors, "id", "left").join(roles, "id", "left").join(moved, "id", "left")
    return rows.select(
        content_id("semau", function_id=F.col("id"), contract_id=F.col("contract_id")).alias("chain_id"), F.col("id").alias("function_id"), F.coalesce("actor", F.lit("unknown")).alias("actor"), F.coalesce("kind", F.lit("unknown")).alias("authority_kind"),
        "subject", "transition_id", F.coalesce("impact", F.lit("unknown")).alias("impact"), F.array_sort("modifiers").alias("gate"), F.when(F.col("actor").isNull(), "partial").otherwise("complete").alias("status"))
