"""Steps whose rows must not outgrow their input: counted in the plans that ran."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


def most_rows(df) -> int:
    """Collects ``df``; the most rows that any join of its plan gave."""
    df.collect()

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in name:
            return walk(plan.plan())
        rows = plan.metrics().get("numOutputRows") if "Join" in name else None
        children = plan.children()
        return max([rows.get().value() if rows is not None and rows.isDefined() else 0] + [walk(children.apply(i)) for i in range(children.size())])

    return walk(df._jdf.queryExecution().executedPlan())


def test_claims_meet_each_caller_once(spark):
    from provloom.operators import holdings

    made = spark.createDataFrame([("t", "v1", "c", "Tok", "erc20", None, ["v1"]), ("l", "v2", "c", "Pool", "lp", "t", ["v2"])],
                                 "asset_id string, state_var_id string, contract_id string, name string, asset_type string, represents_asset_id string, basis array<string>")
    contracts = spark.createDataFrame([("ct", "Tok"), ("cl", "Pool"), ("base", "Base")] + [(f"x{k}", f"X{k}") for k in range(60)], "id string, name string")
    bases = spark.createDataFrame([(c, "base", "INHERITS") for c in ["ct", "cl"] + [f"x{k}" for k in range(60)]], "source string, target string, type string")
    functions = spark.createDataFrame([("bal", "base", holdings.ENTITLEMENT)], "id string, contract_id string, signature string")
    uses = spark.createDataFrame([("CALLS", "h", "bal")] * 200 + [("READS", "f", "v2")] * 50, "type string, source string, target string")
    found = holdings.claims(made, contracts, functions, bases, uses)
    assert most_rows(found) <= 200
    assert {(r["holder_ref"], r["claim_on"], r["via"]) for r in found.collect()} == {("h", "t", "l"), ("f", "t", "l")} and found.count() == 2


def test_only_calls_ask_for_their_target(spark):
    from provloom.operators import semantic

    functions = spark.createDataFrame([("f", "c", "n", "payable", [], "a"), ("g", "c", "m", "payable", [], "a")], "id string, contract_id string, name string, mutability string, modifiers array<string>, file string")
    links = [(f"r{k}", "READS", "f", f"s{k % 3}", None, "a", 1, 2) for k in range(100)] + [("k", "CALLS", "f", "g", "external", "a", 1, 2), ("l", "CALLS", "gone", "g", "external", "a", 1, 2)]
    links = spark.createDataFrame(links, "id string, type string, source string, target string, call_kind string, file string, line_start long, line_end long")
    facts = spark.createDataFrame([], "id string, subject string, predicate string, value string, file string, line_start long, line_end long")
    made, _ = semantic.state_transitions(functions, links, facts, spark.createDataFrame([], "file string, code string"))
    assert most_rows(made) <= 5
    found = {r["function_id"]: (r["reads"], [e["target_ref"] for e in r["external_effects"]], len(r["basis"])) for r in made.collect()}
    assert found == {"f": (["s0", "s1", "s2"], ["g"], 102), "g": ([], [], 1)}


def test_numbered_moves_no_group_whole(spark):
    from pyspark.sql import functions as F

    from provloom.operators.order import numbered
    from provloom.storage import Scratch

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") < 10, "few").otherwise("many").alias("g"), "id")
        made = numbered(rows, ["g"], [-F.col("id")], "place", Scratch(spark, "numbered"), "rows")
        found = {(r["g"], r["id"]): r["place"] for r in made.collect()}
        assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {("few" if k < 10 else "many", k): 10 - k if k < 10 else 3000 - k for k in range(3000)}


def shuffled(spark, job) -> int:
    """Rows that all stages of ``job`` wrote to shuffles, joins by broadcast switched off."""
    jvm, store = spark._jvm, spark._jsc.sc().statusStore()

    def total():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = total()
        job()
        return total() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def long_walk(spark):
    functions = [(f"f{k:02d}", "public" if k == 0 else "internal", []) for k in range(12)] + [(f"g{k:03d}", "internal", []) for k in range(400)]
    calls = [(f"r{k:02d}", f"f{k:02d}", f"f{k + 1:02d}", "internal") for k in range(11)] + [(f"s{k:03d}", f"g{k:03d}", "gone", "internal") for k in range(400)]
    return spark.createDataFrame(functions, "id string, visibility string, modifiers array<string>"), spark.createDataFrame(calls, "id string, source string, target string, call_kind string"), spark.createDataFrame([], "id string, subject string, value string")


def test_routes_move_their_hops_once(spark):
    from provloom.operators import routes

    functions, calls, markers = long_walk(spark)
    pairs, names, conditions = spark.createDataFrame([], "id string, source string, target string"), spark.createDataFrame([], "id string"), spark.createDataFrame([], "id string, function string")
    found = []
    moved = shuffled(spark, lambda: found.extend(routes.routes(functions, calls, markers, pairs, names, conditions)[0].collect()))
    assert len(found) == 400 + 66 and moved < 6 * (411 + 412)


def test_contexts_move_their_edges_once(spark):
    from provloom.operators import graph

    functions, calls, _ = long_walk(spark)
    roots, found = functions.selectExpr("id as root"), []
    moved = shuffled(spark, lambda: found.extend(graph.contexts(calls, roots).collect()))
    assert len(found) == 412 + 400 + 66 and moved < 5 * (411 + 412)


def test_influences_gather_accesses_once(spark):
    from provloom.operators import artifacts

    functions = spark.createDataFrame([(f"f{k}",) for k in range(100)], "id string")
    reads = [(f"r{k}", "READS" if k % 2 else "WRITES", f"f{k % 100}", f"s{k % 50}", "a", k, k) for k in range(800)]
    reads = spark.createDataFrame(reads, "id string, type string, source string, target string, file string, line_start int, line_end int")
    calls = spark.createDataFrame([("c", "f0", "f50"), ("c", "f0", "f50"), ("d", "f1", "f51")], "id string, source string, target string")
    gates = spark.createDataFrame([(f"g{k}", f"f{k}", ["x"]) for k in range(100)], "id string, function string, basis array<string>")
    found = []
    moved = shuffled(spark, lambda: found.extend(artifacts.influences(artifacts.attributed_accesses(reads, functions), gates, calls).collect()))
    assert sorted(r["kind"] for r in found) == ["call-supported"] * 16 + ["control-supported"] * 800 and moved < 4 * 800

def test_influences_of_more_accesses_lie_in_more_buckets(spark):
    from provloom.operators import artifacts

    accesses = spark.createDataFrame([("s1", "f0", ["w"], []), ("s1", "f1", [], ["r"])], "location string, function string, write_ids array<string>, read_ids array<string>")
    calls = spark.createDataFrame([("c", "f0", "f1")], "id string, source string, target string")
    made = artifacts.influences(accesses, spark.createDataFrame([], "id string, function string, basis array<string>"), calls, rows=1_000_000)
    assert sorted(r["kind"] for r in made.collect()) == ["call-supported", "data-supported"]
    assert "out of 11" in made._jdf.queryExecution().toString()



@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_unknown_records_leave_edges_and_facts_alone(spark):
    from provloom.plans.records import esm_unknowns

    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert shuffled(spark, lambda: esm_unknowns(spark, DATA).collect()) < 1.5 * lines


def test_discovery_moves_its_edges_once(spark):
    from provloom.operators import graph

    _, calls, _ = long_walk(spark)
    found = []
    moved = shuffled(spark, lambda: found.extend(graph.discovered(calls, spark.createDataFrame([("f00",)], "root string"), 8, [])[0].collect()))
    assert [r["place"] for r in sorted(found, key=lambda r: r["hop"])] == list(range(1, 10)) and moved < 4 * 411


def test_trust_moves_its_effects_once(spark):
    from provloom.operators import assets, trust

    functions = spark.createDataFrame([(f"f{k}", f"c{k % 5}", "n", f"s{k % 3}()", "internal", []) for k in range(20)], "id string, contract_id string, name string, signature string, visibility string, parameters array<string>")
    contracts = spark.createDataFrame([(f"c{k}", f"C{k}", "contract") for k in range(5)], "id string, name string, contract_type string")
    effects = spark.createDataFrame([(f"t{k // 2}", k % 2, f"f{k % 20}", [f"r{k}"]) for k in range(2000)], "transition_id string, place int, target_ref string, basis array<string>")
    facts = spark.createDataFrame([(f"t{k}", f"g{k}", f"fact:{k}" if k < 50 else None) for k in range(1000)], "transition_id string, function_id string, fact string")
    nothing = spark.createDataFrame([], "id string, name string"), spark.createDataFrame([], "source string, target string")
    found = []
    moved = shuffled(spark, lambda: found.extend(trust.trust_model(effects, functions, contracts, *nothing, facts, assets.DEPENDENCY_PINS)["assumptions"].collect()))
    assert len(found) == 5 and moved < 3 * 2000


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_first_links_move_least_orders_alone(spark):
    from provloom.plans.graphs import actor_link_first

    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert shuffled(spark, lambda: actor_link_first(spark, DATA).collect()) < lines / 4


def test_only_ways_to_the_ends_stay(spark):
    from provloom.operators import graph

    ways = [("a", "b"), ("b", "end"), ("end", "on"), ("on", "further"), ("c", "dead"), ("x", "y"), ("y", "x"), ("y", "end")]
    edges, ends = spark.createDataFrame(ways, "source string, target string"), spark.createDataFrame([("end",)], "id string")
    found = {(r["source"], r["target"]) for r in graph.leading_to(edges, ends).collect()}
    assert found == {("a", "b"), ("b", "end"), ("x", "y"), ("y", "x"), ("y", "end")}
    assert graph.leading_to(edges, ends.where("id = 'none'")).count() == 2


def test_compositions_move_their_steps_once(spark):
    from provloom.operators import records
    from provloom.storage import Scratch

    functions, calls, _ = long_walk(spark)
    steps = calls.selectExpr("source as function_id", "id as site", "'call-inline' as operator", "target")
    steps = steps.unionByName(spark.createDataFrame([("f03", "x", "call-inline", "f01"), ("f04", "y", "call-inline", None), ("gone", "z", "call-inline", "away")], steps.schema))
    roots, found = functions.select("id").unionByName(spark.createDataFrame([("f10",)], "id string")), []
    moved = shuffled(spark, lambda: found.extend(records.compositions(roots, steps, Scratch(spark, "compositions")).collect()))
    after = {}
    for r in steps.collect():
        after.setdefault(r["function_id"], []).append(r)
    expected = []

    def walk(root, chain, depth):
        for s in after.get(chain[-1], []):
            flag = "unresolved" if s["target"] is None else "cyclic" if s["target"] in chain else "bound-hit" if depth > 8 else "taken"
            expected.append((root, depth, chain, s["operator"], s["site"], flag))
            if flag == "taken":
                walk(root, [*chain, s["target"]], depth + 1)

    for r in roots.collect():
        walk(r["id"], [r["id"]], 1)
    key = lambda r: (r[0], r[2], r[4])
    assert sorted(((r["root"], r["depth"], r["chain"], r["operator"], r["site"], r["flag"]) for r in found), key=key) == sorted(expected, key=key)
    assert {r["flag"] for r in found} == {"taken", "unresolved", "cyclic", "bound-hit"} and moved < 3 * (414 + 413)


def test_pairs_meet_accesses_once(spark):
    from provloom.operators import holdings

    kinds = ["debt", "collateral", "erc20", "unknown"]
    made = [(f"a{k:03d}", f"v{k}", f"c{k // 4}", kinds[k % 4], [f"v{k}"]) for k in range(200)]
    made = spark.createDataFrame(made, "asset_id string, state_var_id string, contract_id string, asset_type string, basis array<string>")
    accesses = spark.createDataFrame([(f"f{j}", f"v{k}") for k in range(200) for j in range(5)] * 2, "source string, target string")
    found = []
    moved = shuffled(spark, lambda: found.extend(holdings.accounting_pairs(made, accesses).collect()))
    assert {(*r["endpoints"], r["relation_kind"], len(r["accessors"])) for r in found} == {(f"a{k:03d}", f"a{k + 1:03d}", "debt_collateral", 5) for k in range(0, 200, 4)}
    assert len(found) == 50 and moved < 4.5 * 1000
