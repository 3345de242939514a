"""A whole state checked at once: unique ids, confidence, basis and all references between its tables.

A state is a dict of tables by name.  Tables and columns may be absent, which is as if they
were empty; other columns and tables are not looked at.  Each table is read once for each of
the three kinds of checks; all references of all tables meet one registry of ids in one join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provloom.operators.validation import epistemic_violations

ENTITIES = ["project", "contracts", "functions", "state_variables", "assets", "roles", "dependencies"]
#: Tables of epistemic records and the kind that each holds, in the order in which they are judged.
EPISTEMIC = {"facts": "fact", "observations": "observation", "assumptions": "assumption", "hypotheses": "hypothesis", "evidence": "evidence"}
TABLES = [*ENTITIES, "relationships", *EPISTEMIC]

CLAIMS = ["facts", "observations", "assumptions", "hypotheses"]
#: Fixed values: (check, table, columns, tables that may hold what they name).
REFERENCES = [
    ("relationship-endpoints", "relationships", ["source_id", "target_id"], ENTITIES),
    ("fact-subject", "facts", ["subject_id"], ENTITIES),
    ("fact-object", "facts", ["object_id"], ENTITIES),
    ("observation-basis", "observations", ["based_on"], ["facts"]),
    ("assumption-basis", "assumptions", ["based_on"], ["observations"]),
    ("hypothesis-basis", "hypotheses", ["based_on"], ["assumptions", "observations"]),
    ("hypothesis-entities", "hypotheses", ["affected_entities"], ENTITIES),
    ("evidence-supports", "evidence", ["supports"], CLAIMS),
    ("evidence-contradicts", "evidence", ["contradicts"], CLAIMS),
]
#: Checks by rank; the first that fails decides.
IDENTITY, CONFIDENCE, RULES, INTEGRITY = range(4)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def _ids(state: dict[str, DataFrame]) -> DataFrame | None:
    return _union([state[t].select(F.col("id").cast("string").alias("id"), F.lit(t).alias("held_in")) for t in TABLES if t in state])


def _named(table: DataFrame, columns: list[str]) -> Column:
    """What a row names in these columns, in order; nulls name nothing."""
    lists = [F.coalesce(F.col(c) if t.startswith("array") else F.array(c), F.array()).cast("array<string>") for c in columns for n, t in table.dtypes if n == c]
    return F.filter(F.concat(*lists), lambda x: x.isNotNull()) if lists else F.array().cast("array<string>")


def _tagged(table: DataFrame, check: str, columns: list[str], allowed: list[str]) -> Column:
    tag = lambda ref, i: F.struct(F.lit(check).alias("check"), i.alias("position"), ref.alias("ref"), F.array(*map(F.lit, allowed)).alias("allowed"))
    return F.transform(_named(table, columns), tag)


def references(state: dict[str, DataFrame]) -> DataFrame | None:
    """(check, source, position, ref, allowed): every reference with the tables that may hold it."""
    parts = []
    for name in dict.fromkeys(t for _, t, _, _ in REFERENCES if t in state):
        checks = [_tagged(state[name], check, columns, allowed) for check, t, columns, allowed in REFERENCES if t == name]
        parts.append(state[name].select(F.col("id").cast("string").alias("source"), F.explode(F.concat(*checks)).alias("r")).select("r.check", "source", "r.position", "r.ref", "r.allowed"))
    return _union(parts)


def lost_references(state: dict[str, DataFrame]) -> DataFrame | None:
    """(check, source, position, missing): references to what none of the allowed tables holds.

    ``position`` is the place from 0 in the record's own list, so that the list can be made
    again without a group of all its parts; a name that stands twice is missing twice.
    """
    named = references(state)
    if named is None:
        return None
    held = _ids(state).groupBy("id").agg(F.collect_set("held_in").alias("held_in"))
    lost = named.join(held, F.col("ref") == F.col("id"), "left").where(~F.coalesce(F.arrays_overlap("held_in", "allowed"), F.lit(False)))
    return lost.select("check", "source", "position", F.col("ref").alias("missing"))


def _records(state: dict[str, DataFrame]) -> DataFrame | None:
    def listed(table: DataFrame, column: str) -> Column:
        return (F.transform(column, lambda x: x.cast("string")) if column in table.columns else F.lit(None).cast("array<string>")).alias(column)

    level = lambda t: (F.col("level") if "level" in t.columns else F.lit(None)).cast("string").alias("level")
    return _union([state[t].select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), level(state[t]), *[listed(state[t], c) for c in ("based_on", "provenance", "supports", "contradicts")]) for t, kind in EPISTEMIC.items() if t in state])


def state_violations(state: dict[str, DataFrame]) -> DataFrame:
    """(rank, place, code, check, source, missing) of everything that is wrong with a state.

    ``rank`` and ``place`` are the order of judgement: ids that stand twice in any tables,
    confidence, then basis, both by kind of record, then references.  ``missing`` holds what a
    reference names and is null elsewhere.  A state without
    any of the tables is refused.
    """
    if not any(t in state for t in TABLES):
        raise ValueError(f"a state has some of the tables {', '.join(TABLES)}")
    none = F.lit(None).cast("string")
    row = lambda rank, place, code, check, source, missing: [F.lit(rank).alias("rank"), place.cast("int").alias("place"), code.alias("code"), check.alias("check"), source.alias("source"), missing.alias("missing")]
    twice = _ids(state).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    found = [twice.select(*row(IDENTITY, F.lit(0), F.lit("DuplicateCanonicalEntity"), F.lit("unique"), F.col("id"), none))]
    records = _records(state)
    if records is not None:
        wrong = _union([epistemic_violations(records.where(F.col("kind") == k)).withColumn("kind", F.lit(k)).withColumn("place", F.lit(i)) for i, k in enumerate(EPISTEMIC.values())])
        rank = F.when(F.col("code") == "InvalidConfidence", CONFIDENCE).otherwise(RULES)
        found.append(wrong.select(*row(0, F.col("place"), F.col("code"), F.col("kind"), F.col("source"), none)).withColumn("rank", rank))
    lost = lost_references(state)
    if lost is not None:
        found.append(lost.select(*row(INTEGRITY, F.lit(0), F.lit("InvalidReconState"), F.col("check"), F.col("source"), F.col("missing"))))
    return _union(found)


def deciding_code(violations: DataFrame) -> str | None:
    """The code that a saver reports: of the first rank, the first place; None for a valid state."""
    # Within a kind's basis its provenance is asked for before what it supports.
    order = F.struct("rank", "place", (F.col("code") != "MissingProvenance").alias("later"))
    return violations.agg(F.min_by("code", order).alias("code")).first()["code"]
