"""Small hand-made cases: cycles, diamonds, depths, precedence and order independence."""

from provloom.operators import aggregate, graph, integrity, lineage, resolve, scope


def rows(df):
    return sorted(map(tuple, df.collect()))


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, target string")


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


def test_reach_diamond_cycle_and_depth(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("x", "y"))
    assert rows(graph.reach(e, roots(spark, "a"), 5)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2)]
    assert rows(graph.reach(e, roots(spark, "a"), 0)) == [("a", "a", 0)]
    assert rows(graph.related_entities(e, roots(spark, "a", "y"), 1)) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 1), ("y", "x", 1)]
    assert rows(graph.related_entities(e, roots(spark, "a"), -3)) == []


def test_truncation_is_about_unvisited_nodes_only(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("p", "q"), ("q", "r"))
    assert rows(graph.traced(e, roots(spark, "a", "p"), 1)[1]) == [("a", False), ("p", True)]


def test_closure_paths_contexts_and_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "b"), ("a", "c"))
    assert rows(graph.transitive_closure(e)) == [("a", "b"), ("a", "c"), ("b", "c"), ("c", "b")]
    paths = sorted(r["path"] for r in graph.simple_paths(e, roots(spark, "a"), 5).collect())
    assert paths == [["a", "b"], ["a", "b", "c"], ["a", "c"], ["a", "c", "b"]]
    chains = {r["node"]: r["chain"] for r in graph.contexts(e.selectExpr("source || target as id", "source", "target"), roots(spark, "a")).collect()}
    assert chains == {"a": [], "b": ["ab"], "c": ["ac"]}
    assert rows(graph.cycle_residue(e)) == [("a", "b"), ("a", "c"), ("b", "c"), ("c", "b")]
    assert rows(graph.cycle_residue(edges(spark, ("a", "b"), ("b", "c")))) == []


def test_call_outcomes(spark):
    sites = spark.createDataFrame([(1, "c1", "f()"), (2, "c1", "g()"), (3, "zz", "f()")], "site int, contract string, signature string")
    declared = spark.createDataFrame([("c1", "f()"), ("c1", "f()"), ("zz", "f()")], "contract string, signature string")
    known = spark.createDataFrame([("c1",)], "contract string")
    got = {r["site"]: r["outcome"] for r in resolve.resolve_calls(sites, declared, known).collect()}
    assert got == {1: "resolved", 2: "unresolved", 3: "outside"}


def test_family_needs_all_pins_of_just_one(spark):
    pins = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3")], "family string, signature string")
    have = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("c", "2"), ("c", "3")], "contract string, signature string")
    assert rows(resolve.family_of(have, pins)) == [("a", "x"), ("b", "unknown"), ("c", "unknown")]


def test_first_site_gives_the_kind_in_any_row_order(spark):
    data = [("CALLS", "f", "g", 2, "late", 0), ("CALLS", "f", "g", 1, "first", 0), ("CALLS", "f", "h", 3, "only", 0)]
    frame = lambda rows_: spark.createDataFrame(rows_, "type string, source string, target string, seq long, kind string, tie long")
    expected = [("CALLS", "f", "g", 2, "first", 1, 2), ("CALLS", "f", "h", 1, "only", 3, 3)]
    assert rows(aggregate.aggregate_edges(frame(data))) == rows(aggregate.aggregate_edges(frame(data[::-1]).repartition(5))) == expected


def test_scope_precedence_counts_and_vacuous_ratios(spark):
    files = spark.createDataFrame([("a.sol", 1), ("b.sol", 1), ("c.sol", 1), ("lib/d.sol", 1), ("node_modules/e.sol", 1), ("big.sol", 99), ("x.txt", 1)], "path string, bytes long")
    issues = spark.createDataFrame([("b.sol", "compilation_failed", "UNKNOWN"), ("c.sol", "odd", "UNKNOWN"), ("lib/d.sol", "odd", "UNKNOWN")], "file string, code string, severity string")
    inv = scope.inventory(files, ["**/*.sol"], ["lib/**"], 10)
    missing = scope.not_found(spark.createDataFrame([("gone.sol",), ("a.sol",)], "path string"), files)
    got = {r["path"]: (r["status"], r["rule"]) for r in scope.entries(inv, issues, missing).collect()}
    assert got == {
        "a.sol": ("ANALYZED", None), "b.sol": ("UNSUPPORTED", None), "c.sol": ("UNRESOLVED", None), "lib/d.sol": ("EXCLUDED", "config:excludes:lib/**"),
        "node_modules/e.sol": ("EXCLUDED", "always:node_modules"), "big.sol": ("EXCLUDED", "limit:maxFileBytes"), "gone.sol": ("NOT_FOUND", None)}
    failed = {r["path"]: r["status"] for r in scope.entries(inv, issues, missing, failed=True).collect()}
    assert failed["a.sol"] == failed["c.sol"] == "FAILED" and failed["b.sol"] == "UNSUPPORTED"
    none = scope.entries(inv.where("false"), issues, missing.where("false"))
    assert rows(scope.metrics(none)) == [("clean_coverage", 1, 1), ("failed_rate", 0, 1), ("not_found_rate", 0, 1), ("resolution_completeness", 1, 1), ("unsupported_rate", 0, 1)]


def test_run_differences_and_trace_status(spark):
    a = spark.createDataFrame([("e1", "h"), ("e2", "h"), ("e3", "h")], "entity_id string, content_hash string")
    b = spark.createDataFrame([("e2", "h"), ("e3", "other"), ("e4", "h")], "entity_id string, content_hash string")
    assert rows(lineage.compare_runs(a, b)) == [("e1", "removed"), ("e2", "unchanged"), ("e3", "changed"), ("e4", "added")]
    entities = spark.createDataFrame([("e1", True), ("e2", True), ("e3", True), ("e9", False)], "entity_id string, material boolean")
    got = rows(lineage.trace_status(entities, a.where("entity_id <> 'e3'"), b.where("entity_id = 'e2'")))
    assert got == [("e1", "PARTIAL"), ("e2", "COMPLETE"), ("e3", "MISSING"), ("e9", "NOT_APPLICABLE")]
    outputs = spark.createDataFrame([("e", "r9", False), ("e", "r1", True), ("f", "r1", False), ("f", "r2", False)], "entity_id string, run_id string, is_current boolean")
    assert rows(lineage.producing_run(outputs)) == [("e", "r1"), ("f", "r2")]


def test_integrity_checks(spark):
    links = spark.createDataFrame([("l1", "a"), ("l2", "z"), ("l3", None)], "id string, target string")
    known = spark.createDataFrame([("a",)], "id string")
    assert rows(integrity.dangling("ends", links, "id", "target", known, "id")) == [("ends", "l2", "z")]
    assert rows(integrity.unequal_registries(links, known, "id")) == [("a", "right"), ("l1", "left"), ("l2", "left"), ("l3", "left")]


def test_fingerprint_ignores_partitioning(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") * 7).cast("string").alias("v"))
    one = aggregate.table_fingerprint(df, F.col("k"), F.col("v")).first()
    assert one == aggregate.table_fingerprint(df.repartition(7).orderBy(F.rand(1)), F.col("k"), F.col("v")).first()
    assert one != aggregate.table_fingerprint(df.where("id <> 3"), F.col("k"), F.col("v")).first()


def test_fingerprint_of_a_tree_that_ends_at_a_depth(spark):
    from hashlib import sha256

    df = spark.range(40).selectExpr("cast(id as string) k", "concat('v', id) v")
    got = aggregate.table_fingerprint(df, df["k"], df["v"], leaf_rows=1, max_depth=1).first()
    digest = lambda lines: sha256("\n".join(lines).encode()).hexdigest()
    leaves = {}
    for k in sorted(map(str, range(40))):
        leaves.setdefault(sha256(k.encode()).hexdigest()[0], []).append(f"{k} v{k}")
    assert tuple(got) == (digest(f"{at} {digest(leaves[at])}" for at in sorted(leaves)), 40)
