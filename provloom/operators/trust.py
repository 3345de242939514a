"""What a contract relies on outside itself, and the rules its evidence must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provloom.functions.canonical import content_id
from provloom.operators.order import code_units, sorted_by_units
from provloom.storage import Scratch, buckets_for


def dependencies(relationships: DataFrame, functions: DataFrame) -> DataFrame:
    """(dependency, calls, callers, first_kind) of resolved kinds of calls, by the target's contract."""
    owners = functions.select(F.col("id").alias("target"), F.col("contract_id").alias("_owner"))
    calls = relationships.where("type = 'CALLS' and call_kind is not null").join(owners, "target", "left")
    named = calls.withColumn("dependency", F.concat(F.lit("external:"), F.coalesce("_owner", F.lit("unknown"))))
    order = F.struct("file", "line_start", "line_end", "id", "call_kind")
    return named.groupBy("dependency").agg(F.count("*").alias("calls"), F.count_distinct("source").alias("callers"), F.min_by("call_kind", order).alias("first_kind"))


#: Visibilities that an entry point may have.
ENTRY_VISIBILITY = ["public", "external"]


def is_entry(visibility: Column) -> Column:
    return visibility.isin(ENTRY_VISIBILITY)


def takes_callbacks(parameters: Column) -> Column:
    """Whether any parameter type is an address, or holds calldata or bytes."""
    return F.exists(parameters, lambda p: (p == "address") | p.contains("calldata") | p.contains("bytes"))


def callbacks(functions: DataFrame, implementers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surface, unknowns) of functions(id, contract_id, visibility, parameters).

    A surface function is one that anyone may call with an address or bytes; it is consumed
    if any contract other than its own implements an interface, else its direction is
    unknown.  Whether such a contract exists depends on two numbers only: how many
    implementers there are, and whether the function's own is the only one.
    """
    some = implementers.agg(F.count_distinct("contract").alias("n"), F.min("contract").alias("one")).first()
    consumed = F.lit(some["n"] > 1) | (F.lit(some["n"] == 1) & (F.col("contract_id") != F.lit(some["one"])))
    open_ = functions.where(is_entry(F.col("visibility")) & takes_callbacks(F.col("parameters")))
    surface = open_.select(F.col("id").alias("function_id"), F.when(consumed, "consumed").otherwise("unknown").alias("direction"))
    unknowns = surface.where("direction = 'unknown'").select(F.col("function_id").alias("record_ref"), F.lit("direction").alias("field"), F.lit("no_evidence").alias("reason"), F.array("function_id").alias("basis"))
    return surface, unknowns


def missing_fields(provenance: DataFrame, rules: dict[str, list[list[str]]], names: dict[str, str] | None = None) -> DataFrame:
    """Records that lack what their source type requires: per rule one of several fields; ``missing`` names it."""
    broken = F.lit(None).cast("string")
    for kind, groups in rules.items():
        for fields in groups:
            absent = F.col("source_type") == kind
            for f in fields:
                absent = absent & F.col(f).isNull()
            broken = F.coalesce(broken, F.when(absent, F.lit((names or {}).get(kind, fields[0]))))
    return provenance.withColumn("missing", broken).where("missing is not null")


def remapped(path: Column, remappings: list[str], importer: Column | None = None) -> Column:
    """The path under the first remapping ``prefix=target`` that it begins with.

    ``context:prefix=target`` counts only where the importing file begins with the context.
    """
    found = F.lit(None).cast("string")
    for text in remappings:
        prefix, _, target = text.partition("=")
        context, prefix = prefix.split(":", 1) if ":" in prefix and "://" not in prefix else ("", prefix)
        fits = F.startswith(path, F.lit(prefix))
        if context:
            fits = fits & (F.startswith(importer, F.lit(context)) if importer is not None else F.lit(False))
        found = F.coalesce(found, F.when(fits, F.concat(F.lit(target), F.substr(path, F.lit(len(prefix) + 1)))))
    return F.coalesce(found, path)


#: The families of signatures that name the kind of a dependency, in the order they are tried.
KINDS = ["oracle", "dex"]


def call_targets(functions: DataFrame, contracts: DataFrame, states: DataFrame) -> DataFrame:
    """(target_ref, dep_key, name, capability) of all that is in scope.

    functions(id, contract_id, signature), contracts(id, name), states(id, name).
    """
    named = functions.join(contracts.select(F.col("id").alias("contract_id"), F.col("name").alias("_name")), "contract_id").select(F.col("id").alias("target_ref"), F.concat(F.lit("external:"), "_name").alias("dep_key"), F.col("_name").alias("name"), F.col("signature").alias("capability"))
    key = F.concat(F.lit("statevar:"), "name")
    known = functions.select(F.col("id").alias("target_ref"))
    variables = states.join(known, states["id"] == known["target_ref"], "left_anti").select(F.col("id").alias("target_ref"), key.alias("dep_key"), "name", key.alias("capability"))
    return named.unionByName(variables).where("dep_key is not null")


def trust_model(effects: DataFrame, functions: DataFrame, contracts: DataFrame, states: DataFrame, implements: DataFrame, transition_facts: DataFrame, pins: dict[str, list[str]]) -> dict[str, DataFrame]:
    """What is relied on outside: dependencies, links, capabilities, observations, assumptions and unknown drafts.

    A dependency is a called contract by its name, a state variable by its name, or an open
    function that takes callbacks.  A called contract's kind is the first of ``KINDS`` that
    has the signature which is called first, by transition and place; all others are unknown.

    effects(transition_id, place, target_ref, basis), functions(id, contract_id, name, signature,
    visibility, parameters), contracts(id, name, contract_type), states(id, name),
    implements(source, target), transition_facts(transition_id, function_id, fact): the facts that
    a transition rests on (fact may be null).  links(dependency, direction, basis) are rows, since a
    hub's calls have no bound that one row could hold.

    What is met is moved once, without its basis, into buckets by transition; signatures, counts and
    facts are gathered there first, so that no task sorts or hashes more than a bucket of it.
    Effects meet their targets by hash joins, which hold targets alone and stream a hub's calls.
    """
    scratch = Scratch(effects.sparkSession, "trust")
    buckets = buckets_for(effects.count() + functions.count())
    targets = call_targets(functions, contracts, states)
    lost = effects.join(targets.select("target_ref"), "target_ref", "left_anti").select(F.col("transition_id").alias("record_ref"), F.lit("external_effects").alias("field"), F.lit("out_of_scope_target").alias("reason"), sorted_by_units(F.col("basis")).alias("basis"))
    hooks = contracts.where("contract_type = 'interface'").select(F.col("id").alias("target"))
    implementers = implements.join(hooks, "target", "left_semi").join(contracts.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("contract"))
    surface, open_drafts = callbacks(functions, implementers)
    own = surface.join(functions.withColumnRenamed("id", "function_id"), "function_id").withColumn("dep_key", F.concat_ws(":", F.lit("callback"), "contract_id", "name"))

    told = lambda basis: F.filter(basis, lambda b: F.startswith(b, F.lit("fact:"))).alias("told")
    lean = effects.select("transition_id", "place", "target_ref", told(F.col("basis"))).join(targets.hint("shuffle_hash"), "target_ref")
    observed = lean.select("dep_key", "name", F.lit("observed").alias("direction"), "capability", F.col("transition_id").alias("at"), "place", "transition_id", "told", F.startswith("dep_key", F.lit("external:")).alias("called"))
    transition_of = transition_facts.select("function_id", "transition_id").distinct()
    taken = own.join(transition_of, "function_id", "left").select("dep_key", F.concat(F.lit("callback:"), "name").alias("name"), "direction", F.col("signature").alias("capability"), F.col("function_id").alias("at"), F.lit(0).alias("place"), "transition_id", told(F.array("function_id")), F.lit(False).alias("called"))
    # What has no transition is spread by the function.
    rows = observed.unionByName(taken).withColumns({"held": F.col("transition_id").isNotNull(), "lot": F.coalesce("transition_id", "at", F.lit(""))}).drop("transition_id")
    rows = scratch.keep_bucketed(rows, "rows", buckets, "lot")

    once = rows.groupBy("lot", "at", "dep_key", "name", "direction", "capability").agg(F.min("place").alias("place"), F.count("*").alias("calls"), F.max("called").alias("called"))
    seen = F.struct(code_units(F.col("at")).alias("t"), "place")
    once = scratch.keep(once.groupBy("dep_key", "name", "direction", "capability").agg(F.min(seen).alias("at"), F.sum("calls").alias("calls"), F.max("called").alias("called")), "once")
    kind = F.lit(None).cast("string")
    for family in KINDS:
        kind = F.coalesce(kind, F.when(F.col("_first").isin(pins[family]), F.lit(family)))
    first = once.groupBy("dep_key", "name").agg(F.min_by("capability", F.struct("at", "capability")).alias("_first"), F.max("called").alias("called"), F.sum("calls").alias("calls"))
    named = first.withColumn("dependency_type", F.when(F.col("called"), F.coalesce(kind, F.lit("unknown"))).otherwise("unknown"))
    dependencies = named.select(content_id("semdep", dep_key=F.col("dep_key"), name=F.col("name"), dependency_type=F.col("dependency_type")).alias("id"), "dep_key", "name", "dependency_type", "calls")
    ids = dependencies.select("dep_key", F.col("id").alias("dependency"))
    # Ids join the targets and the surface, which are fewer than their effects and less often of one dependency.
    named_targets = targets.join(ids, "dep_key").select("target_ref", "dependency")
    met = effects.select("target_ref", F.explode("basis").alias("basis")).join(named_targets.hint("shuffle_hash"), "target_ref").select("dependency", F.lit("observed").alias("direction"), "basis")
    links = met.unionByName(own.join(ids, "dep_key").select("dependency", "direction", F.col("function_id").alias("basis"))).repartition(buckets, "dependency", "direction", "basis").distinct()

    # Signatures in the order they are met, each once: as many as a contract has functions.
    mine = once.groupBy("dep_key", "direction", "capability").agg(F.min("at").alias("at"))
    listed = mine.groupBy("dep_key", "direction").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "capability"))), lambda x: x["capability"]).alias("capabilities"))
    borne = transition_facts.where("fact is not null").select(F.col("transition_id").alias("lot"), "fact")
    held = rows.where("held").select("lot", "dep_key", "direction").distinct().join(borne, "lot").select("dep_key", "direction", "fact")
    facts = held.unionByName(rows.select("dep_key", "direction", F.explode("told").alias("fact"))).repartition(buckets, "dep_key", "direction", "fact").distinct()
    facts = facts.groupBy("dep_key", "direction").agg(sorted_by_units(F.collect_list("fact")).alias("based_on"))
    none = F.array().cast("array<string>")
    said = listed.join(facts, ["dep_key", "direction"], "left").join(ids, "dep_key").withColumn("based_on", F.coalesce("based_on", none)).withColumn("statement", capability_statement())
    said = said.withColumn("observation", content_id("semobs", statement=F.col("statement"), based_on=F.col("based_on")))
    trusted = F.format_string("Trust assumption for %s capability on %s: the external dependency behaves as expected for %s", "direction", "dependency", F.array_join("capabilities", ", "))
    said = said.withColumn("trusted", trusted).withColumn("assumption", content_id("semasm", statement=F.col("trusted"), based_on=F.array("observation")))
    made = said.select("*", sorted_by_units(F.col("capabilities")).alias("_sorted"))
    ident = content_id("semtc", dependency_ref=F.col("dependency"), direction=F.col("direction"), capabilities=F.col("_sorted"))
    capabilities = made.select(ident.alias("id"), "dependency", "direction", F.col("_sorted").alias("capabilities"), F.col("assumption").alias("trust_assumption_ref"))
    basis = links.groupBy("dependency", "direction").agg(sorted_by_units(F.collect_list("basis")).alias("basis"))
    failing = capabilities.join(basis, ["dependency", "direction"]).select(F.col("id").alias("record_ref"), F.lit("failure_semantics").alias("field"), F.lit("no_evidence").alias("reason"), "basis")
    return {
        "dependencies": dependencies, "links": links, "capabilities": capabilities,
        "observations": said.select(F.col("observation").alias("id"), "statement", "based_on"),
        "assumptions": said.select(F.col("assumption").alias("id"), F.col("trusted").alias("statement"), F.array("observation").alias("based_on")),
        "unknowns": lost.unionByName(open_drafts).unionByName(failing),
    }


def capability_statement() -> Column:
    """Over direction, dependency and capabilities (an array, in the order met)."""
    return F.format_string("Observed %s capability on %s via %s", "direction", "dependency", F.array_join("capabilities", ", "))
