"""Records of knowledge: content ids of every kind, provenance lists, unknowns, patches, the ladder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provloom.functions.canonical import content_id
from provloom.operators.order import code_units, numbered
from provloom.storage import buckets_for

#: Why something is unknown.
UNKNOWN_REASONS = [
    "no_evidence", "unresolved_call", "unsupported_assembly", "out_of_scope_target", "syntactic_fidelity", "dropped_file",
    "no-return-linkage", "no-branch-evidence", "sub-path-unobservable", "location-unidentified", "alias-possible",
    "value-unobservable", "ordering-unobservable", "ambiguous-source-kind", "runtime-unobservable", "context-shift", "bound-hit", "cyclic",
]
#: The fields of each kind of record that its id is made of; lists are sorted first.
ID_FIELDS = {
    "rel": ["type", "source_id", "target_id", "metadata", "provenance"],
    "fact": ["type", "subject_id", "predicate", "object_id", "value", "confidence", "provenance"],
    "obs": ["type", "statement", "based_on", "provenance", "confidence"],
    "asm": ["type", "statement", "based_on", "confidence", "status"],
    "hyp": ["type", "statement", "based_on", "affected_entities", "required_conditions", "confidence", "status"],
    "evidence": ["evidence_type", "description", "supports", "contradicts", "provenance"],
}


def record_id(kind: str, records: DataFrame) -> Column:
    """The content id of a record of ``kind``; provenance holds ids, confidence a struct."""
    kinds = dict(records.dtypes)
    value = lambda c: F.array_sort(c) if kinds[c].startswith("array") else F.col(c)
    return content_id(kind, **{c: value(c) for c in ID_FIELDS[kind] if c in kinds})


def edges_with_provenance(sites: DataFrame) -> DataFrame:
    """One edge per (type, source, target) with its sites' provenance in the order first seen."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "tie", "span")))
    return sites.groupBy("type", "source", "target").agg(F.array_distinct(F.transform(listed, lambda x: x["span"])).alias("provenance"))


def provenance_registry(records: DataFrame) -> DataFrame:
    """(id, content): every provenance that a record cites, once."""
    return records.select(F.explode("provenance").alias("p")).select("p.*").distinct()


def patch_lineage(records: DataFrame) -> DataFrame:
    """Per patch the distinct files and spans that its records cite, sorted."""
    return records.groupBy("patch").agg(F.array_sort(F.collect_set("file")).alias("files"), F.array_sort(F.collect_set("span")).alias("spans"))


def unknowns(*drafts: DataFrame, distinct: bool = False) -> DataFrame:
    """(id, scope, reason, basis) of drafts (scope, reason, basis), equal ones once.

    ``distinct`` says that no two are equal, whatever the order of their bases: none is moved then.
    Drafts with a reason that is none of the fixed ones, or without basis, stop the job.
    """
    every = reduce(DataFrame.unionByName, [x.select("scope", "reason", "basis") for x in drafts])
    sound = F.col("reason").isin(UNKNOWN_REASONS) & (F.size("basis") > 0)
    basis = F.when(sound, F.array_sort("basis")).otherwise(F.raise_error(F.concat(F.lit("bad unknown record: "), F.col("scope"))))
    made = every.select("scope", "reason", basis.alias("basis"))
    named = made.select(content_id("seme", scope=F.col("scope"), reason=F.col("reason"), basis=F.col("basis")).alias("id"), "*")
    return named if distinct else named.dropDuplicates(["id"])


def ordered_unknowns(found: DataFrame, scratch) -> DataFrame:
    """Unknowns (record_ref, field, reason, basis) with their final place: by code units, the text of the basis last."""
    keys = [code_units(F.col(c)) for c in ("record_ref", "field", "reason")] + [code_units(F.to_json("basis"))]
    return numbered(found.select("record_ref", "field", "reason", "basis"), [], keys, "place", scratch, "unknowns")


def event_error_patch(uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, issues) of uses(kind: event or error, subject, signature, file, line_start, line_end, seq).

    A fact per function and signature, with its spans in the order seen; uses without a
    signature are counted per file as issues.
    """
    named = uses.where("signature is not null")
    event = F.col("kind") == "event"
    value = F.when(event, F.col("signature")).otherwise(F.concat(F.lit("custom-error:"), "signature"))
    span = F.concat_ws("-", F.concat_ws(":", "file", F.col("line_start").cast("string")), F.col("line_end").cast("string"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", span.alias("span")))), lambda x: x["span"])
    facts = named.groupBy(F.col("subject").alias("subject_id"), F.when(event, "EMITS").otherwise("USES").alias("predicate"), value.alias("value")).agg(listed.alias("provenance"))
    code = F.when(event, "event_unresolved").otherwise("error_unresolved")
    issues = uses.where("signature is null").groupBy(code.alias("code"), "file").agg(F.lit("UNKNOWN").alias("severity"), F.count("*").alias("n"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    return facts, issues


def merge_patches(patches: list[DataFrame], order: str = "patch") -> tuple[DataFrame, DataFrame]:
    """(records, conflicts) of patches(id, content): the first of each id, and ids of several contents."""
    every = reduce(DataFrame.unionByName, [p.withColumn(order, F.lit(k)) for k, p in enumerate(patches)])
    held = every.groupBy("id").agg(F.min_by("content", F.struct(order, "content")).alias("content"), F.count_distinct(F.coalesce("content", F.lit("\0"))).alias("_many"))
    return held.select("id", "content"), held.where("_many > 1").select("id")


def ladder(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, assumptions) of sources(statement, facts): one of each per source with facts."""
    rows = sources.where(F.size("facts") > 0).select("statement", F.array_sort(F.array_distinct("facts")).alias("based_on"))
    observed = rows.select(content_id("semobs", statement=F.col("statement"), based_on=F.col("based_on")).alias("id"), "statement", "based_on", F.lit("DERIVED").alias("level")).dropDuplicates(["id"])
    statement = F.format_string("Security assumption: the behavior observed in %s holds under operational conditions", "id")
    assumed = observed.select(statement.alias("statement"), F.array("id").alias("based_on"))
    assumed = assumed.select(content_id("semasm", statement=F.col("statement"), based_on=F.col("based_on")).alias("id"), "statement", "based_on", F.lit("INFERRED").alias("level"), F.lit("OPEN").alias("status"))
    return observed, assumed


def transition_statement() -> Column:
    """Over name, reads and writes of a transition."""
    return F.format_string("Function %s reads %d state variables and writes %d state variables", "name", F.size("reads"), F.size("writes"))


def asset_statement() -> Column:
    return F.format_string("Asset %s (%s) identified in contract", "name", "asset_type")


def authority_statement() -> Column:
    return F.format_string("Authority chain for %s with %s authority", "function_id", "authority_kind")


def owners(functions: DataFrame, accesses: DataFrame, boundaries: DataFrame, influences: DataFrame, paths: DataFrame) -> DataFrame:
    """(function_id, tag, record): which function each execution record belongs to.

    Accesses belong to the sources of their relationships, boundaries to their sites'
    functions, influences to both ends that are functions, paths to their first step.
    """
    known = functions.select(F.col("id").alias("function_id")).distinct()
    tagged = [
        accesses.select(F.col("source").alias("function_id"), F.lit("access").alias("tag"), "record"),
        boundaries.select(F.col("source").alias("function_id"), F.lit("boundary").alias("tag"), "record"),
        influences.select(F.explode(F.array("writer", "reader")).alias("function_id"), F.lit("influence").alias("tag"), "record"),
        paths.select(F.element_at("path", 1).alias("function_id"), F.lit("path").alias("tag"), "record"),
    ]
    return reduce(DataFrame.unionByName, tagged).join(known, "function_id", "left_semi").distinct()


def successors(calls: DataFrame, markers: DataFrame, bases: DataFrame, functions: DataFrame) -> DataFrame:
    """(function_id, site, operator, target) of what a composition of a function takes in next.

    calls(id, source, target, call_kind), markers(id, subject, value), bases(id, source,
    target: contracts), functions(id, contract_id).  A target is null where the callee is
    not known.
    """
    known = functions.select(F.col("id").alias("target"), F.lit(True).alias("_known"))
    c = calls.join(known.hint("shuffle_hash"), "target", "left")
    kind, found = F.col("call_kind"), F.col("_known").isNotNull()
    operator = F.when(kind == "delegatecall", "delegate-shift").when(kind.isNull() | (kind == "") | found | (kind == "internal"), "call-inline").otherwise("callback-reentry")
    target = F.when(found & kind.isNotNull() & (kind != ""), F.col("target"))
    called = c.select(F.col("source").alias("function_id"), F.col("id").alias("site"), operator.alias("operator"), target.alias("target"))
    shifted = F.when(F.col("value") == "unresolved-delegatecall", "delegate-shift").otherwise("callback-reentry")
    marked = markers.join(functions.select(F.col("id").alias("subject")), "subject", "left_semi").select(F.col("subject").alias("function_id"), F.col("id").alias("site"), shifted.alias("operator"), F.lit(None).cast("string").alias("target"))
    own = functions.select(F.col("id").alias("function_id"), F.col("contract_id").alias("source"))
    inherited = own.join(bases.select("id", "source", F.col("target").alias("base")), "source").select("function_id", F.col("id").alias("site"), F.lit("inherit-merge").alias("operator"), F.col("base").alias("target"))
    return called.unionByName(marked).unionByName(inherited)


def compositions(roots: DataFrame, steps: DataFrame, scratch, max_depth: int = 8) -> DataFrame:
    """(root, depth, chain, operator, site, flag): the fragments that composing each root takes in.

    A frontier of chains: each step extends a root's chain by its successors; a target that
    the chain holds already is cut as ``cyclic``, one beyond the bound as ``bound-hit``.
    """
    times = roots.groupBy(F.col("id").alias("function_id")).agg(F.count("*").cast("int").alias("times"))
    edges = scratch.keep(steps.select("function_id", "site", "operator", "target").join(times.hint("shuffle_hash"), "function_id", "left"), "successors")
    # The first step is the successors of the roots themselves; later ones meet only those of functions that are some target.
    targets = edges.select(F.col("target").alias("function_id")).distinct()
    far = edges.select("function_id", "site", "operator", "target").join(targets.hint("shuffle_hash"), "function_id", "left_semi")
    far = scratch.keep(far, "far")
    heads = far.select(F.col("function_id").alias("target")).distinct().withColumn("goes_on", F.lit(True))
    nexts = scratch.keep_bucketed(far.join(heads, "target", "left").select("function_id", "site", "operator", "target", "goes_on"), "nexts", buckets_for(edges.count() // 2), "function_id")

    def flag(depth: int):
        return F.when(F.col("target").isNull(), "unresolved").when(F.array_contains("chain", F.col("target")), "cyclic").when(F.lit(depth > max_depth), "bound-hit").otherwise("taken")

    first = edges.withColumn("_each", F.explode(F.array_repeat(F.lit(0), "times"))).withColumn("chain", F.array("function_id"))
    parts, depth = [first.select(F.col("function_id").alias("root"), F.lit(1).alias("depth"), "chain", "operator", "site", "target", flag(1).alias("flag"))], 1
    frontier = parts[0].where("flag = 'taken'")
    while depth <= max_depth:
        frontier = frontier.select("root", F.col("target").alias("at"), F.concat("chain", F.array("target")).alias("chain"))
        depth += 1
        near = frontier.join(nexts.hint("shuffle_hash"), F.col("at") == F.col("function_id"))
        level = scratch.keep(near.select("root", F.lit(depth).alias("depth"), "chain", "operator", "site", "target", flag(depth).alias("flag"), "goes_on"), f"level-{depth}")
        parts.append(level.drop("goes_on"))
        frontier = level.where("goes_on and flag = 'taken'")
        if frontier.isEmpty():
            break
    scratch.drop("far", "nexts")
    return reduce(DataFrame.unionByName, parts)
