"""Semantic layers on small hand-made states: every rule once, in any row order."""

from provloom.operators import assets, execution, semantic, trust

REL = "id string, type string, source string, target string, call_kind string, file string, line_start long, line_end long"
FACT = "id string, subject string, predicate string, value string, file string, line_start long, line_end long"
FN = "id string, contract_id string, name string, mutability string, modifiers array<string>, file string"


def state(spark):
    functions = spark.createDataFrame([("f1", "c1", "a", "payable", ["onlyOwner"], "A.sol"), ("f2", "c1", "b", "view", [], "A.sol"), ("f3", "c2", "x", "view", [], "Bad.sol"), ("f4", "c3", "y", "view", [], "Asm.sol")], FN)
    relationships = spark.createDataFrame([
        ("r1", "READS", "f1", "s1", None, "A.sol", 5, 5), ("r2", "WRITES", "f1", "s1", None, "A.sol", 6, 6), ("r3", "WRITES", "f1", "s2", None, "A.sol", 7, 7),
        ("r5", "CALLS", "f1", "f2", "internal", "A.sol", 9, 9), ("r4", "CALLS", "f1", "gone", "external", "A.sol", 8, 8), ("r6", "CALLS", "f1", "f2", "odd", "A.sol", 3, 3), ("r7", "CALLS", "f2", "f1", "internal", "A.sol", 12, 12)], REL)
    facts = spark.createDataFrame([("e2", "f1", "EMITS", "B()", "A.sol", 11, 11), ("e1", "f1", "EMITS", "A()", "A.sol", 10, 10), ("k1", "f1", "CALLS", "unresolved-lowlevel-call", "A.sol", 2, 2), ("k2", "f1", "CALLS", "other", "A.sol", 1, 1)], FACT)
    issues = spark.createDataFrame([("Bad.sol", "compilation_failed"), ("Asm.sol", "unsupported_assembly")], "file string, code string")
    return functions, relationships, facts, issues


def test_transitions_and_unknowns(spark):
    parts = state(spark)
    made, unknowns = semantic.state_transitions(*parts)
    rows = {r["function_id"]: r for r in made.collect()}
    assert set(rows) == {"f1", "f2", "f4"}
    f1 = rows["f1"]
    assert (f1["reads"], f1["writes"], f1["readwrite"], f1["observations"]) == (["s1"], ["s1", "s2"], ["s1"], ["e1", "e2"])
    assert [(e["call_kind"], e["target_ref"], e["evidence"]) for e in f1["external_effects"]] == [("lowlevel", None, "E3"), ("external", None, "E3"), ("internal", "f2", "E1")]
    assert (f1["value_handling"], f1["state_mutation"], rows["f2"]["state_mutation"], rows["f4"]["fidelity_flags"]) == ("payable", "storage", "none", ["assembly_skipped"])
    found = {(r["record_ref"], r["field"], r["reason"]): r["basis"] for r in unknowns.collect()}
    assert found == {
        (f1["id"], "external_effects", "no_evidence"): ["r6"], (f1["id"], "external_effects", "out_of_scope_target"): ["r4"], (f1["id"], "external_effects", "unresolved_call"): ["k1"],
        ("f3", "transition", "dropped_file"): ["f3"], (rows["f4"]["id"], "fidelity_flags", "unsupported_assembly"): ["f4"]}
    shuffled = semantic.state_transitions(*[p.repartition(5) for p in parts])[0]
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, made.collect()))


def test_authority(spark):
    functions, relationships, facts, issues = state(spark)
    made, _ = semantic.state_transitions(functions, relationships, facts, issues)
    states = spark.createDataFrame([("s1", "IAdmin"), ("s2", "IOwnable")], "id string, type string")
    rows = {r["function_id"]: r for r in semantic.authority_chains(functions, relationships, states, made).collect()}
    assert (rows["f1"]["actor"], rows["f1"]["authority_kind"], rows["f1"]["subject"], rows["f1"]["impact"], rows["f1"]["status"]) == ("f2", "owner", "s1", "external", "complete")
    assert (rows["f3"]["actor"], rows["f3"]["transition_id"], rows["f3"]["status"]) == ("unknown", None, "partial")
    assert rows["f4"]["transition_id"] is None and rows["f1"]["chain_id"][6:] == rows["f1"]["transition_id"][5:]


def test_assets_by_pinned_closures(spark):
    contracts = spark.createDataFrame([("cash", "Cash"), ("base", "Base"), ("debt", "Debt"), ("twin1", "Twin"), ("twin2", "Twin"), ("both", "Both")], "id string, name string")
    pins = assets.PINS
    given = {"base": pins["erc20"], "debt": pins["debt"], "both": pins["debt"] + pins["reward"], "cash": []}
    functions = spark.createDataFrame([(f"{c}:{s}", c, s) for c, names in given.items() for s in names], "id string, contract_id string, signature string")
    links = spark.createDataFrame([("INHERITS", "cash", "base"), ("INHERITS", "base", "cash"), ("IMPLEMENTS", "debt", "outside")], "type string, source string, target string")
    states = spark.createDataFrame([("s1", "pool", "Cash"), ("s2", "pool", "Debt"), ("s3", "pool", "Twin"), ("s4", "pool", "address"), ("s5", "other", "Debt"), ("s6", "pool", "Both")], "id string, contract_id string, type string")
    made, unknowns = assets.assets(states, contracts, functions, links)
    rows = {r["state_var_id"]: r for r in made.collect()}
    assert {k: r["asset_type"] for k, r in rows.items()} == {"s1": "erc20", "s2": "debt", "s5": "debt", "s6": "unknown"}
    assert rows["s2"]["represents_asset_id"] == rows["s1"]["asset_id"] and rows["s5"]["represents_asset_id"] is None
    assert sorted(r["record_ref"] for r in unknowns.collect()) == ["s3", "s4"]


def test_accesses_boundaries_and_trust(spark):
    functions, relationships, facts, _ = state(spark)
    same_line = relationships.withColumn("line_start", relationships["line_start"] * 0 + 1).withColumn("line_end", relationships["line_end"] * 0 + 1)
    ops = {r["location"]: (r["op"], r["basis"]) for r in execution.state_accesses(same_line).collect()}
    assert ops == {"s1": ("readwrite", ["r1", "r2"]), "s2": ("write", ["r3"])}
    assert sorted((r["site"], r["target"]) for r in execution.external_boundaries(relationships, functions, facts).collect()) == [("k1", "k1"), ("r4", "unknown"), ("r6", "f2")]
    deps = {r["dependency"]: (r["calls"], r["first_kind"]) for r in trust.dependencies(relationships, functions).collect()}
    assert deps == {"external:c1": (3, "odd"), "external:unknown": (1, "external")}
    one = spark.createDataFrame([("c1",)], "contract string")
    surface = spark.createDataFrame([("f1", "c1", "public", ["address"]), ("f2", "c2", "external", ["uint256", "bytes calldata"]), ("f3", "c2", "internal", ["address"]), ("f4", "c3", "public", ["uint256"]), ("f5", "c3", "public", [])], "id string, contract_id string, visibility string, parameters array<string>")
    found, unknown = trust.callbacks(surface, one)
    assert {r["function_id"]: r["direction"] for r in found.collect()} == {"f1": "unknown", "f2": "consumed"} and [r["record_ref"] for r in unknown.collect()] == ["f1"]
    assert {r["direction"] for r in trust.callbacks(surface, one.where("false"))[0].collect()} == {"unknown"}


def test_pairs_need_a_common_accessor_and_claims_a_reader(spark):
    from provloom.operators import holdings

    made = spark.createDataFrame(
        [("t", "sv1", "c", "Tok", "erc20", None, ["sv1"]), ("l", "sv2", "c", "Pool", "lp", "t", ["sv2"]), ("d", "sv3", "c", "Debt", "debt", "t", ["sv3"]), ("k", "sv4", "c", "Col", "collateral", "t", ["sv4"])],
        "asset_id string, state_var_id string, contract_id string, name string, asset_type string, represents_asset_id string, basis array<string>")
    uses = spark.createDataFrame([("WRITES", "f", "sv1"), ("READS", "f", "sv2"), ("READS", "g", "sv2"), ("READS", "f", "sv3"), ("READS", "g", "sv4"), ("CALLS", "h", "bal:k")], "type string, source string, target string")
    pairs = holdings.accounting_pairs(made, uses.where("type <> 'CALLS'")).collect()
    assert [(r["relation_kind"], r["endpoints"], r["accessors"], r["basis"]) for r in pairs] == [("reserves_liquidity", ["l", "t"], ["f"], ["c", "f", "sv1", "sv2"])]
    contracts = spark.createDataFrame([("ct", "Tok"), ("cl", "Pool"), ("cd", "Debt"), ("ck", "Col")], "id string, name string")
    fns = spark.createDataFrame([("bal:t", "ct", holdings.ENTITLEMENT), ("bal:k", "ck", holdings.ENTITLEMENT)], "id string, contract_id string, signature string")
    none = spark.createDataFrame([], "source string, target string, type string")
    found = holdings.claims(made, contracts, fns, none, uses).collect()
    assert {(r["holder_ref"], r["claim_on"], r["via"]) for r in found} == {("f", "t", "l"), ("g", "t", "l"), ("f", "t", "d"), ("g", "t", "k"), ("h", "t", "k")} and len(found) == 5
    assert holdings.claims(made.limit(0), contracts, fns, none, uses).count() == 0 == holdings.accounting_pairs(made.limit(0), uses).count()
