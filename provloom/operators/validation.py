"""Validators of state, scope and semantic records: each returns its violations as rows.

A valid table has no rows; ``first_failure`` names the code that decides, in the order in
which the checks are given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provloom.storage import Scratch

#: The confidence that each kind of record must have.
CONFIDENCE = {"fact": "VERIFIED", "observation": "DERIVED", "assumption": "INFERRED", "hypothesis": "SPECULATIVE"}
#: Entity types that a run's outputs may have.
MATERIAL = ["contract", "function", "state_variable", "relationship", "fact"]
#: Evidence kinds that each status of a scope entry allows.
ALLOWED_EVIDENCE = {
    "ANALYZED": ["analysis", "issue"], "UNRESOLVED": ["analysis", "issue"], "UNSUPPORTED": ["issue"],
    "FAILED": ["run_error"], "EXCLUDED": ["exclude_rule", "size_limit"], "NOT_FOUND": ["walk_miss"],
}
#: How the rule of an excluded entry begins.
EXCLUDE_PREFIXES = ["config:excludes:", "always:", "type:"]
FALLBACK = "syntactic_fallback"


def _cases(rows: DataFrame, source: str, cases: list[tuple[str, Column]]) -> DataFrame:
    """(code, source) of every case that a row meets."""
    met = F.filter(F.array(*[F.when(condition, F.lit(code)) for code, condition in cases]), lambda c: c.isNotNull())
    return rows.select(F.col(source).alias("source"), F.explode(met).alias("code")).select("code", "source")


def epistemic_violations(records: DataFrame) -> DataFrame:
    """(code, source) over records(kind, id, level, based_on, provenance, supports, contradicts)."""
    kind = F.col("kind")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    expected = F.coalesce(*[F.when(kind == k, F.lit(level)) for k, level in CONFIDENCE.items()])
    return _cases(records, "id", [
        ("InvalidConfidence", expected.isNotNull() & ~F.col("level").eqNullSafe(expected)),
        ("MissingProvenance", kind.isin("fact", "evidence") & none("provenance")),
        ("InvalidEpistemicDependency", kind.isin("assumption", "hypothesis") & none("based_on")),
        ("InvalidEpistemicDependency", (kind == "observation") & none("based_on") & none("provenance")),
        ("InvalidEvidenceReference", (kind == "evidence") & none("supports") & none("contradicts")),
    ])


def traceability_violations(runs: DataFrame, derivations: DataFrame, outputs: DataFrame, material: DataFrame, source_files: DataFrame, current_run: str | None) -> DataFrame:
    """(source, missing) of runs(id), derivations(id, run_id, inputs, outputs: arrays of (entity_type,
    entity_id)), outputs(run_id, entity_type, entity_id) and material(entity_type, entity_id).

    Membership and uniqueness hold for every run; that derivations resolve and cover all
    material entities is asked of the current run alone.
    """
    pair = lambda source, missing: [source.cast("string").alias("source"), missing.cast("string").alias("missing")]
    twice = lambda df, name, key: df.groupBy(key.alias("k")).count().where("count > 1").select(*pair(F.lit(name), F.col("k")))
    run_ids = runs.select(F.col("id").alias("run_id")).distinct()
    key = F.concat_ws("|", "run_id", "entity_type", "entity_id")
    found = [
        twice(runs, "runs", F.col("id")),
        twice(derivations, "derivations", F.col("id")),
        twice(outputs, "outputs", key),
        derivations.join(run_ids, "run_id", "left_anti").select(*pair(F.col("id"), F.col("run_id"))),
        outputs.join(run_ids, "run_id", "left_anti").select(*pair(key, F.col("run_id"))),
        outputs.where(~F.col("entity_type").isin(MATERIAL)).select(*pair(key, F.col("entity_type"))),
    ]
    if current_run is not None:
        mine = derivations.where(F.col("run_id") == current_run)
        made = mine.select("id", F.explode("outputs").alias("o")).select("id", "o.entity_type", "o.entity_id")
        read = mine.select("id", F.explode("inputs").alias("i")).where("i.entity_type = 'source_file'").select("id", F.col("i.entity_id").alias("path"))
        found += [
            made.join(material, ["entity_type", "entity_id"], "left_anti").select(*pair(F.col("id"), F.col("entity_id"))),
            read.join(source_files.select("path").distinct(), "path", "left_anti").select(*pair(F.col("id"), F.col("path"))),
            material.join(made, ["entity_type", "entity_id"], "left_anti").select(*pair(F.lit(current_run), F.col("entity_id"))),
        ]
    return reduce(DataFrame.unionByName, found)


def scope_violations(entries: DataFrame) -> DataFrame:
    """(code, source) of entries(path, status, evidence: array of (kind, file, code, severity, rule)).

    Codes: issue_attribution, evidence_missing, evidence_contradicted, duplicate_entry, path.
    """
    status, evidence = F.col("status"), F.col("evidence")
    has = lambda kind: F.exists(evidence, lambda e: e["kind"] == kind)
    issue = lambda test: F.exists(evidence, lambda e: (e["kind"] == "issue") & test(e))
    unknown = issue(lambda e: e["severity"] == "UNKNOWN")
    broken = issue(lambda e: e["code"] == "compilation_failed")
    allowed = F.lit(False)
    for name, kinds in ALLOWED_EVIDENCE.items():
        allowed = allowed | ((status == name) & F.forall(evidence, lambda e: e["kind"].isin(kinds)))
    well_formed = lambda e: F.coalesce(*[F.when(F.startswith(e["rule"], F.lit(p)), F.lit(True)) for p in EXCLUDE_PREFIXES], F.lit(False))
    analyzed, excluded = status == "ANALYZED", status == "EXCLUDED"
    rows = _cases(entries, "path", [
        ("path", F.col("path").rlike(r"^/|\\|(^|/)\.\.(/|$)") | (F.col("path") == "")),
        ("issue_attribution", issue(lambda e: ~e["file"].eqNullSafe(F.col("path")))),
        ("evidence_missing", analyzed & ~has("analysis")),
        ("evidence_contradicted", analyzed & (unknown | broken | issue(lambda e: e["code"] != FALLBACK) | has("run_error"))),
        ("evidence_missing", (status == "UNRESOLVED") & ~unknown),
        ("evidence_missing", (status == "UNSUPPORTED") & ~broken),
        ("evidence_missing", (status == "FAILED") & ~has("run_error")),
        ("evidence_contradicted", excluded & F.exists(evidence, lambda e: (e["kind"] == "exclude_rule") & ~well_formed(e))),
        ("evidence_missing", excluded & ~has("exclude_rule") & ~has("size_limit")),
        ("evidence_contradicted", excluded & (F.size(evidence) != 1)),
        ("evidence_missing", (status == "NOT_FOUND") & ~has("walk_miss")),
        ("evidence_contradicted", ~allowed),
    ])
    twice = entries.groupBy("path").count().where("count > 1").select(F.lit("duplicate_entry").alias("code"), F.col("path").alias("source"))
    return rows.distinct().unionByName(twice)


def report_violations(counts: DataFrame, n_entries: Column, run_status: str, bound_run: str | None, current_run: str | None) -> DataFrame:
    """(code, source) of a scope report's one row of counts, and of the run that it binds."""
    statuses = ("analyzed", "excluded", "not_found", "unresolved", "unsupported", "failed")
    total = reduce(lambda a, b: a + b, [F.col(s) for s in statuses])
    done = F.lit(run_status == "COMPLETED")
    return _cases(counts.withColumn("report", F.lit("report")), "report", [
        ("counts_inconsistent", total != n_entries),
        ("counts_inconsistent", F.col("expected") != n_entries - F.col("excluded")),
        ("run_binding", done & (F.lit(bound_run is None or bound_run != current_run) | (F.col("failed") != 0))),
        ("run_binding", ~done & (F.lit(bound_run is not None) | (F.col("analyzed") != 0) | (F.col("unresolved") != 0))),
    ])


def provenance_outside(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(path): files that provenance cites and that no entry has as ANALYZED or UNRESOLVED."""
    return files.select("path").where("path <> ''").distinct().join(entries.where("status in ('ANALYZED', 'UNRESOLVED')").select("path"), "path", "left_anti")


def unresolved_basis(refs: DataFrame, *universes: DataFrame) -> DataFrame:
    """(record, ref) whose ref is the id of no universe(id)."""
    known = reduce(DataFrame.union, [u.select("id") for u in universes]).select(F.col("id").alias("ref")).distinct()
    return refs.select("record", "ref").distinct().join(known, "ref", "left_anti").select("record", "ref")


def unattributed(refs: DataFrame, known: DataFrame) -> DataFrame:
    """(record) of refs(record, ref) from which no chain of refs leads to a known(id).

    Attribution spreads from the known ids, each record once, so cycles end and a step
    carries only what the last one found.
    """
    scratch = Scratch(refs.sparkSession, "attribution")
    edges = scratch.keep(refs.select("record", "ref").distinct(), "refs")
    seen = scratch.keep(edges.join(known.select(F.col("id").alias("ref")).distinct(), "ref", "left_semi").select("record").distinct(), "found-0")
    frontier, step = seen, 0
    while not frontier.isEmpty():
        step += 1
        near = edges.join(frontier.select(F.col("record").alias("ref")), "ref", "left_semi").select("record").distinct()
        frontier = scratch.keep(near.join(seen, "record", "left_anti"), f"found-{step}")
        seen = seen.union(frontier)
    lost = scratch.keep(edges.select("record").distinct().join(seen, "record", "left_anti"), "unattributed")
    scratch.drop("refs", *(f"found-{k}" for k in range(step + 1)))
    return lost


def rootless(refs: DataFrame, *universes: DataFrame) -> DataFrame:
    """(ref): refs that are no record themselves and the id of no universe."""
    roots = refs.select("ref").distinct().join(refs.select(F.col("record").alias("ref")).distinct(), "ref", "left_anti")
    return unresolved_basis(roots.select(F.lit("").alias("record"), "ref"), *universes).select("ref")


def first_failure(violations: DataFrame, order: list[str]) -> str | None:
    """The code, first in ``order``, that any violation has."""
    rank = F.coalesce(*[F.when(F.col("code") == c, F.lit(k)) for k, c in enumerate(order)], F.lit(len(order)))
    row = violations.agg(F.min_by("code", rank).alias("code")).first()
    return row["code"]
