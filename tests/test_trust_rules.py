"""Trust and influence on hand-made states."""

from provloom.operators import artifacts, assets, trust

PRICE, SWAP = assets.DEPENDENCY_PINS["oracle"][0], assets.DEPENDENCY_PINS["dex"][0]


def test_dependencies_take_the_kind_of_the_signature_called_first(spark):
    functions = spark.createDataFrame([("f1", "A", "swap", SWAP, "internal", ["uint256"]), ("f2", "A", "price", PRICE, "internal", []), ("f3", "B", "other", "other()", "internal", []), ("f4", "C", "price", PRICE, "external", ["address"]), ("f5", "gone", "x", "x()", "internal", [])],
                                      "id string, contract_id string, name string, signature string, visibility string, parameters array<string>")
    contracts = spark.createDataFrame([("A", "Pool", "contract"), ("B", "Pool2", "contract"), ("C", "Feed", "contract"), ("I", "IHook", "interface")], "id string, name string, contract_type string")
    states = spark.createDataFrame([("s1", "vault")], "id string, name string")
    implements = spark.createDataFrame([("C", "I")], "source string, target string")
    effects = spark.createDataFrame([("t2", 0, "f2", ["r3"]), ("t1", 1, "f2", ["r2"]), ("t1", 0, "f1", ["r1"]), ("t1", 2, "f3", ["r4", "fact:k"]), ("t1", 3, "s1", ["r5"]), ("t1", 4, "f5", ["r7", "r6"]), ("t2", 1, None, ["r8"])], "transition_id string, place int, target_ref string, basis array<string>")
    facts = spark.createDataFrame([("t1", "g1", "fact:b"), ("t1", "g1", "fact:a"), ("t2", "g2", None), ("t3", "f4", "fact:c")], "transition_id string, function_id string, fact string")
    made = trust.trust_model(effects, functions, contracts, states, implements, facts, assets.DEPENDENCY_PINS)
    rows = {r["dep_key"]: r for r in made["dependencies"].collect()}
    assert {k: (r["name"], r["dependency_type"], r["calls"]) for k, r in rows.items()} == {
        "external:Pool": ("Pool", "dex", 3), "external:Pool2": ("Pool2", "unknown", 1), "statevar:vault": ("vault", "unknown", 1), "callback:C:price": ("callback:price", "unknown", 1)}
    said = {r["statement"].split(" on ")[1].split(" via ")[0]: (r["statement"].split(" via ")[1], r["based_on"]) for r in made["observations"].collect()}
    ids = {k: r["id"] for k, r in rows.items()}
    assert said == {ids["external:Pool"]: (f"{SWAP}, {PRICE}", ["fact:a", "fact:b"]), ids["external:Pool2"]: ("other()", ["fact:a", "fact:b", "fact:k"]), ids["statevar:vault"]: ("statevar:vault", ["fact:a", "fact:b"]), ids["callback:C:price"]: (PRICE, ["fact:c"])}
    directions = {(r["dependency"], r["direction"]) for r in made["capabilities"].collect()}
    assert directions == {(ids[k], "unknown" if k.startswith("callback") else "observed") for k in ids}  # C alone implements the hook: no other contract would call it
    doubts = {(r["record_ref"], r["field"], r["reason"]): r["basis"] for r in made["unknowns"].collect()}
    assert doubts["t1", "external_effects", "out_of_scope_target"] == ["r6", "r7"] and doubts["t2", "external_effects", "out_of_scope_target"] == ["r8"] and doubts["f4", "direction", "no_evidence"] == ["f4"]
    assert len(doubts) == 3 + 4


def test_influence_takes_the_ids_of_the_two_accesses_alone(spark):
    rel = spark.createDataFrame([
        ("rel:w1", "WRITES", "f", "s", "F", 1, 1), ("rel:r1", "READS", "f", "s", "F", 1, 1), ("rel:w2", "WRITES", "f", "s", "F", 2, 2), ("rel:r3", "READS", "g", "s", "G", 1, 1), ("rel:r4", "READS", "h", "s", "G", 1, 1), ("rel:x", "READS", "off", "s", "G", 1, 1)],
        "id string, type string, source string, target string, file string, line_start int, line_end int")
    functions = spark.createDataFrame([("f",), ("g",), ("h",)], "id string")
    accesses = artifacts.attributed_accesses(rel, functions)
    got = {(r["line_start"], r["function"], tuple(r["write_ids"]), tuple(r["read_ids"])) for r in accesses.collect()}
    assert got == {(1, "f", ("rel:w1",), ("rel:r1",)), (2, "f", ("rel:w2",), ()), (1, "g", (), ("rel:r3", "rel:r4")), (1, "h", (), ("rel:r3", "rel:r4"))}
    conditions = spark.createDataFrame([("k", "g", ["g", "m"])], "id string, function string, basis array<string>")
    calls = spark.createDataFrame([("c1", "f", "g"), ("c2", "f", "f")], "id string, source string, target string")
    rows = {(r["kind"], r["from_ref"], r["to_ref"], tuple(r["evidence"])): r["basis"] for r in artifacts.influences(accesses, conditions, calls).collect()}
    version = lambda x: f"state-version:s@{x}"
    assert rows == {
        ("data-supported", version("f"), version("g"), ("c1", "rel:r3", "rel:r4", "rel:w1")): ["c1", "f", "g", "rel:r3", "rel:r4", "rel:w1", "s"],
        ("data-supported", version("f"), version("g"), ("c1", "rel:r3", "rel:r4", "rel:w2")): ["c1", "f", "g", "rel:r3", "rel:r4", "rel:w2", "s"],
        ("control-supported", "gate:k", version("g"), ("k", "rel:r3", "rel:r4")): ["g", "m", "rel:r3", "rel:r4", "s"],
        ("call-supported", "call-site:c1", version("g"), ("c1", "rel:r3", "rel:r4")): ["c1", "f", "g", "rel:r3", "rel:r4", "s"],
        ("call-supported", "call-site:c2", version("f"), ("c2", "rel:r1", "rel:w1")): ["c2", "f", "rel:r1", "rel:w1", "s"],
        ("call-supported", "call-site:c2", version("f"), ("c2", "rel:w2")): ["c2", "f", "rel:w2", "s"],
    }
