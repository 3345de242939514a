"""Queries of relationships, traversals, lineage, influence and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.operators import aggregate, graph, integrity, lineage, resolve
from provloom.plans import adapters as a
from provloom.plans.adapters import sql
from provloom.plans.registry import query
from provloom.storage import load


@query("relationships_from_to", sql("base_edges", """SELECT node, sum(o)::BIGINT AS n_from, sum(i)::BIGINT AS n_to FROM (SELECT source AS node, 1 AS o, 0 AS i FROM base_edges UNION ALL SELECT target, 0, 1 FROM base_edges) GROUP BY node"""))
def relationships_from_to(spark: SparkSession, d: str) -> DataFrame:
    e = a.base_edges(spark, d)
    ends = e.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_from"), F.sum("i").alias("n_to"))


@query("edges_of_entity", sql("edge_sites", """SELECT type, source, target, count(*) AS sites FROM edge_sites WHERE source = 'contract:nation:3' OR target = 'contract:nation:3' OR target = 'contract:supplier:7' GROUP BY ALL"""))
def edges_of_entity(spark: SparkSession, d: str) -> DataFrame:
    """A point look-up: the filter reaches every scan of the union."""
    e = a.edge_sites(spark, d).where("source = 'contract:nation:3' or target = 'contract:nation:3' or target = 'contract:supplier:7'")
    return e.groupBy("type", "source", "target").agg(F.count("*").alias("sites"))


def _star(spark: SparkSession, d: str) -> DataFrame:
    return a.base_edges(spark, d).select("source", "target").unionByName(a.call_sites(spark, d).select("source", "target"))


@query("related_entities_depth_k", sql("base_edges call_sites", """WITH both_ways AS (SELECT source AS x, target AS y FROM base_edges UNION SELECT target, source FROM base_edges UNION SELECT source, target FROM call_sites UNION SELECT target, source FROM call_sites),
    walk AS (SELECT 'contract:nation:3' AS node, 0 AS hop UNION SELECT y, hop + 1 FROM walk JOIN both_ways ON x = node WHERE hop < 2)
    SELECT node, min(hop) AS hop FROM walk WHERE node <> 'contract:nation:3' GROUP BY node""", recursive=True))
def related_entities_depth_k(spark: SparkSession, d: str) -> DataFrame:
    root = spark.createDataFrame([("contract:nation:3",)], "root string")
    return graph.related_entities(_star(spark, d), root, 2).select("node", "hop")


def _walk_sql(edges: str, up: bool, depth: int, tail: str) -> str:
    x, y = ("target", "source") if up else ("source", "target")
    return f"""WITH walk AS (SELECT root, root AS node, 0 AS hop FROM first_turns UNION SELECT root, {y}, hop + 1 FROM walk JOIN {edges} ON {x} = node WHERE hop < {depth}), found AS (SELECT root, node, min(hop) AS hop FROM walk GROUP BY root, node) {tail}"""


@query("downstream_reasoning", sql("chain first_turns", _walk_sql("chain", False, 5, "SELECT root, node, hop FROM found"), recursive=True))
def downstream_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(a.chain(spark, d), a.first_turns(spark, d), 5)


DISCOVERY_DEPTH = 4


def _discovery_sql(depth: int) -> str:
    steps = ["ways AS (SELECT type, source AS x, target AS y FROM edge_sites UNION SELECT type, target, source FROM edge_sites)",
             "s0 AS (SELECT DISTINCT target AS root, target AS node, 0 AS hop, 1 AS place FROM base_edges WHERE target LIKE 'contract:region:%')"]
    for k in range(1, depth + 1):
        steps.append(f"""f{k} AS (SELECT root, y AS node, place, type FROM s{k - 1} s JOIN ways ON x = node WHERE hop = {k - 1} AND NOT EXISTS (SELECT 1 FROM s{k - 1} z WHERE z.root = s.root AND z.node = y) QUALIFY row_number() OVER (PARTITION BY root, y ORDER BY place, type) = 1)""")
        steps.append(f"""s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT root, node, {k}, met + row_number() OVER (PARTITION BY root ORDER BY place, type, node) FROM f{k} JOIN (SELECT root, count(*) AS met FROM s{k - 1} GROUP BY root) USING (root))""")
    more = f"SELECT DISTINCT root FROM s{depth} s JOIN ways ON x = node WHERE hop = {depth} AND NOT EXISTS (SELECT 1 FROM s{depth} z WHERE z.root = s.root AND z.node = y)"
    return f"WITH {', '.join(steps)} SELECT root, node, hop, place::BIGINT AS place, root IN ({more}) AS truncated FROM s{depth}"


@query("discovery_order", sql("base_edges edge_sites", _discovery_sql(DISCOVERY_DEPTH)))
def discovery_order(spark: SparkSession, d: str) -> DataFrame:
    """What each region reaches, in the order in which a queue would meet it."""
    e = a.edge_sites(spark, d).select("type", "source", "target")
    ways = e.unionByName(e.select("type", F.col("target").alias("source"), F.col("source").alias("target")))
    roots = a.base_edges(spark, d).where("target like 'contract:region:%'").select(F.col("target").alias("root"))
    found, flags = graph.discovered(ways, roots, DISCOVERY_DEPTH, ["type"])
    return found.join(flags, "root")


LAST = "last_turns AS (SELECT conv_id || ':' || max(turn) AS root FROM turns GROUP BY conv_id)"
UP = "walk AS (SELECT root, root AS node, 0 AS hop FROM last_turns UNION SELECT root, source, hop + 1 FROM walk JOIN chain ON target = node WHERE hop < 5), found AS (SELECT root, node, min(hop) AS hop FROM walk GROUP BY root, node)"


def _last_turns(spark: SparkSession, d: str) -> DataFrame:
    return a.turns(spark, d).groupBy("conv_id").agg(F.max("turn").alias("turn")).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("root"))


def _backward(spark: SparkSession, d: str) -> DataFrame:
    return a.chain(spark, d).select(F.col("target").alias("source"), F.col("source").alias("target"))


@query("upstream_reasoning", sql("chain", f"WITH {LAST}, {UP} SELECT root, node, hop FROM found", recursive=True))
def upstream_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(_backward(spark, d), _last_turns(spark, d), 5)


EVIDENCE = "evidence AS (SELECT 'ev:' || event_id AS id, user_id || ':' || (event_id % 4) AS node, CASE WHEN event_type = 'error' THEN 'contradicts' ELSE 'supports' END AS stance FROM events)"


@query("evidence_chain", sql("chain", f"WITH {LAST}, {UP}, {EVIDENCE} SELECT DISTINCT f.root, e.id, e.stance FROM found f JOIN evidence e ON e.node = f.node", recursive=True))
def evidence_chain(spark: SparkSession, d: str) -> DataFrame:
    """Evidence that supports or contradicts what each last turn rests on."""
    e = load(spark, d, "events").select(F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("id"), F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 4).cast("string")).alias("node"), F.when(F.col("event_type") == "error", "contradicts").otherwise("supports").alias("stance"))
    return graph.reach(_backward(spark, d), _last_turns(spark, d), 5).join(e, "node").select("root", "id", "stance").distinct()


@query("transitive_closure", sql("base_edges", """WITH walk AS (SELECT source, target FROM base_edges UNION SELECT w.source, e.target FROM walk w JOIN base_edges e ON e.source = w.target) SELECT source, target FROM walk WHERE source <> target""", recursive=True))
def transitive_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.transitive_closure(a.base_edges(spark, d))


PATHS = "p AS (SELECT root, root AS node, [root] AS path FROM first_turns UNION ALL SELECT root, target, list_append(path, target) FROM p JOIN chain2 ON source = node WHERE len(path) <= 4 AND NOT list_contains(path, target))"


@query("simple_paths_topk", sql("chain2 first_turns", f"""WITH {PATHS}, r AS (SELECT root, array_to_string(path, '>') AS path, row_number() OVER (PARTITION BY root ORDER BY array_to_string(path, '>')) AS n FROM p WHERE len(path) > 1)
    SELECT root, CASE WHEN n <= 3 THEN path ELSE 'dropped' END AS path, count(*) AS routes FROM r GROUP BY 1, 2""", recursive=True))
def simple_paths_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three least routes of each first turn, and how many more there are."""
    paths = graph.simple_paths(a.chain(spark, d, 2), a.first_turns(spark, d), 4).select("root", F.array_join("path", ">").alias("path"))
    from pyspark.sql import Window

    ranked = paths.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("path")))
    return ranked.groupBy("root", F.when(F.col("n") <= 3, F.col("path")).otherwise("dropped").alias("path")).agg(F.count("*").alias("routes"))


@query("contexts_shortest_chain", sql("chain2 first_turns", """WITH w AS (SELECT root, root AS node, 0 AS hop, CAST([] AS VARCHAR[]) AS chain FROM first_turns UNION ALL SELECT root, target, hop + 1, list_append(chain, source || '>' || target) FROM w JOIN chain2 ON source = node WHERE hop < 4),
    best AS (SELECT root, node, min((hop, chain)) AS b FROM w GROUP BY root, node)
    SELECT root, node, b[1] AS hop, array_to_string(b[2], ' ') AS chain FROM best""", recursive=True))
def contexts_shortest_chain(spark: SparkSession, d: str) -> DataFrame:
    edges = a.chain(spark, d, 2).withColumn("id", F.concat("source", F.lit(">"), "target"))
    return graph.contexts(edges, a.first_turns(spark, d), 4).select("root", "node", "hop", F.array_join("chain", " ").alias("chain"))


@query("cycle_residue", sql("chain", """WITH back AS (SELECT conv_id || ':' || max(turn) AS source, conv_id || ':' || min(turn) AS target FROM turns WHERE conv_id % 5 = 0 GROUP BY conv_id HAVING max(turn) > min(turn))
    SELECT source, target FROM (SELECT * FROM chain UNION SELECT * FROM back) WHERE split_part(source, ':', 1)::BIGINT % 5 = 0"""))
def cycle_residue(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth conversation is closed into a ring; only rings remain."""
    ends = a.turns(spark, d).where("conv_id % 5 = 0").groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("first")).where("last > first")
    node = lambda c: F.concat_ws(":", F.col("conv_id").cast("string"), F.col(c).cast("string"))
    return graph.cycle_residue(a.chain(spark, d).unionByName(ends.select(node("last").alias("source"), node("first").alias("target"))))


# Traces: a file → derivation → entity → derivation → summary lineage over documents.

TRACE = """trace AS (SELECT 'file:' || path AS source, 'derivation:' || (doc_id // 10) AS target FROM files UNION SELECT 'derivation:' || (doc_id // 10), 'entity:' || doc_id FROM files
    UNION SELECT 'entity:' || doc_id, 'summary:' || (doc_id % 13) FROM files WHERE doc_id % 3 = 0)"""


def _trace(spark: SparkSession, d: str) -> DataFrame:
    f = a.files(spark, d)
    step = F.concat(F.lit("derivation:"), F.floor(F.col("doc_id") / 10).cast("string"))
    entity = F.concat(F.lit("entity:"), F.col("doc_id").cast("string"))
    rows = f.select(F.concat(F.lit("file:"), "path").alias("source"), step.alias("target")).unionByName(f.select(step.alias("source"), entity.alias("target")))
    return rows.unionByName(f.where("doc_id % 3 = 0").select(entity.alias("source"), F.concat(F.lit("summary:"), (F.col("doc_id") % 13).cast("string")).alias("target"))).distinct()


@query("forward_trace", sql("files", f"""WITH {TRACE}, roots AS (SELECT 'file:' || path AS root FROM files), walk AS (SELECT root, root AS node, 0 AS hop FROM roots UNION SELECT root, target, hop + 1 FROM walk JOIN trace ON source = node WHERE hop < 3)
    SELECT root, node, min(hop) AS hop FROM walk GROUP BY root, node""", recursive=True))
def forward_trace(spark: SparkSession, d: str) -> DataFrame:
    """From every file."""
    roots = a.files(spark, d).select(F.concat(F.lit("file:"), "path").alias("root"))
    return graph.reach(_trace(spark, d), roots, 3)


@query("backward_trace", sql("files", f"""WITH {TRACE}, roots AS (SELECT 'entity:' || doc_id AS root FROM files), walk AS (SELECT root, root AS node, 0 AS hop FROM roots UNION SELECT root, source, hop + 1 FROM walk JOIN trace ON target = node WHERE hop < 2)
    SELECT root, node, min(hop) AS hop FROM walk GROUP BY root, node""", recursive=True))
def backward_trace(spark: SparkSession, d: str) -> DataFrame:
    """From every entity."""
    roots = a.files(spark, d).select(F.concat(F.lit("entity:"), F.col("doc_id").cast("string")).alias("root"))
    return graph.reach(_trace(spark, d).select(F.col("target").alias("source"), F.col("source").alias("target")), roots, 2)


@query("trace_truncated_flag", sql("chain first_turns", _walk_sql("chain", False, 3, """SELECT root, EXISTS (SELECT 1 FROM found f JOIN chain ON source = f.node WHERE f.root = t.root AND f.hop = 3
    AND target NOT IN (SELECT node FROM found g WHERE g.root = t.root)) AS truncated FROM first_turns t"""), recursive=True))
def trace_truncated_flag(spark: SparkSession, d: str) -> DataFrame:
    return graph.traced(a.chain(spark, d), a.first_turns(spark, d), 3)[1]


@query("run_diff", sql("run_a run_b", """SELECT entity_id, CASE WHEN a.content_hash IS NULL THEN 'added' WHEN b.content_hash IS NULL THEN 'removed' WHEN a.content_hash <> b.content_hash THEN 'changed' ELSE 'unchanged' END AS change FROM run_a a FULL JOIN run_b b USING (entity_id)"""))
def run_diff(spark: SparkSession, d: str) -> DataFrame:
    return lineage.compare_runs(*a.run_outputs(spark, d))


@query("producing_run", """SELECT l_partkey AS entity_id, arg_max(l_suppkey, (CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END, l_suppkey)) AS run_id FROM lineitem GROUP BY l_partkey""")
def producing_run(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("run_id"), (F.col("l_suppkey") % 10 == 0).alias("is_current"))
    return lineage.producing_run(rows)


@query("orphan_refs", """SELECT DISTINCT event_id % 5000 AS doc_id FROM events WHERE event_id % 5000 NOT IN (SELECT doc_id FROM documents)""")
def orphan_refs(spark: SparkSession, d: str) -> DataFrame:
    return lineage.orphans(load(spark, d, "events").select((F.col("event_id") % 5000).alias("doc_id")), load(spark, d, "documents"), "doc_id")


@query("incomplete_traces", """SELECT d.doc_id AS entity_id, CASE WHEN d.doc_id % 11 = 0 THEN 'NOT_APPLICABLE' WHEN l.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'COMPLETE' WHEN l.doc_id IS NOT NULL OR b.doc_id IS NOT NULL THEN 'PARTIAL' ELSE 'MISSING' END AS status
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT page_id AS doc_id FROM pages) b ON b.doc_id = d.doc_id""")
def incomplete_traces(spark: SparkSession, d: str) -> DataFrame:
    entities = load(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), (F.col("doc_id") % 11 != 0).alias("material"))
    return lineage.trace_status(entities, load(spark, d, "labels").select(F.col("doc_id").alias("entity_id")), load(spark, d, "pages").select(F.col("page_id").alias("entity_id")))


@query("referential_integrity", """SELECT 'order_customer' AS "check", o_orderkey::VARCHAR AS source, (o_custkey * 2)::VARCHAR AS missing FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'label_document', doc_id::VARCHAR, (doc_id + 100)::VARCHAR FROM labels WHERE doc_id + 100 NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'customer_nation', c_custkey::VARCHAR, (c_nationkey + 3)::VARCHAR FROM customer WHERE c_nationkey + 3 NOT IN (SELECT n_nationkey FROM nation)""")
def referential_integrity(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("c"))
    labels = load(spark, d, "labels").select("doc_id", (F.col("doc_id") + 100).alias("other"))
    customers = load(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") + 3).alias("n"))
    return integrity.all_violations([
        integrity.dangling("order_customer", orders, "o_orderkey", "c", load(spark, d, "customer"), "c_custkey"),
        integrity.dangling("label_document", labels, "doc_id", "other", load(spark, d, "documents"), "doc_id"),
        integrity.dangling("customer_nation", customers, "c_custkey", "n", load(spark, d, "nation"), "n_nationkey"),
    ])


@query("registry_equality", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) a FULL JOIN (SELECT p_partkey * 2 AS k FROM part) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def registry_equality(spark: SparkSession, d: str) -> DataFrame:
    return integrity.unequal_registries(load(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), load(spark, d, "part").select((F.col("p_partkey") * 2).alias("k")), "k")


@query("duplicate_ids", sql("files", "SELECT sha256, count(*) AS n FROM files GROUP BY sha256 HAVING count(*) > 1"))
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return integrity.duplicates(a.files(spark, d), "sha256")


@query("conflicting_content", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def conflicting_content(spark: SparkSession, d: str) -> DataFrame:
    return integrity.conflicts(load(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("sortedness_lag", """SELECT user_id, event_id, before, value FROM (SELECT user_id, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before, value FROM events) WHERE before > value""")
def sortedness_lag(spark: SparkSession, d: str) -> DataFrame:
    return integrity.unsorted_pairs(load(spark, d, "events"), "user_id", "event_id", "value")


@query("keep_first_and_last", """SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id""")
def keep_first_and_last(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("user_id", "event_id", "event_type")
    first = resolve.keep_first(e, ["user_id"], [F.col("event_id")]).select("user_id", F.col("event_type").alias("first_type"))
    return first.join(resolve.keep_first(e, ["user_id"], [F.col("event_id").desc()]).select("user_id", F.col("event_type").alias("last_type")), "user_id")


@query("unknown_basis_union", """SELECT o_custkey AS record, o_orderstatus AS field, o_orderpriority AS reason, array_to_string(list_sort(list_distinct(list(o_orderkey))), ',') AS basis FROM orders GROUP BY 1, 2, 3""")
def unknown_basis_union(spark: SparkSession, d: str) -> DataFrame:
    drafts = load(spark, d, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderstatus").alias("field"), F.col("o_orderpriority").alias("reason"), F.array("o_orderkey").alias("basis"))
    return aggregate.union_of_basis(drafts).select("record", "field", "reason", F.array_join(F.col("basis").cast("array<string>"), ",").alias("basis"))


@query("paired_access", sql("access_sites", """WITH x AS (SELECT DISTINCT target AS location, source AS function, target[-1:] AS t FROM access_sites), rules(l, r) AS (VALUES ('1', '2'), ('3', '4'))
    SELECT a.location AS left_location, b.location AS right_location, count(*) AS accessors, min(a.function) AS first_accessor FROM x a JOIN x b ON a.function = b.function JOIN rules ON a.t = l AND b.t = r GROUP BY 1, 2"""))
def paired_access(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classified locations that some function touches both of."""
    x = a.access_sites(spark, d).select(F.col("target").alias("location"), F.col("source").alias("function")).distinct().withColumn("t", F.substring("location", -1, 1))
    rules = spark.createDataFrame([("1", "2"), ("3", "4")], "t string, r string")
    left = x.join(F.broadcast(rules), "t").select("function", F.col("location").alias("left_location"), "r")
    right = x.select("function", F.col("location").alias("right_location"), F.col("t").alias("r"))
    return left.join(right, ["function", "r"]).groupBy("left_location", "right_location").agg(F.count("*").alias("accessors"), F.min("function").alias("first_accessor"))


@query("fee_split_having", sql("access_sites", """SELECT source AS function, count(DISTINCT target) AS targets FROM access_sites WHERE type = 'WRITES' GROUP BY 1 HAVING count(DISTINCT target) >= 2"""))
def fee_split_having(spark: SparkSession, d: str) -> DataFrame:
    return a.access_sites(spark, d).where("type = 'WRITES'").groupBy(F.col("source").alias("function")).agg(F.count_distinct("target").alias("targets")).where("targets >= 2")


@query("movement_anti_join", """SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def movement_anti_join(spark: SparkSession, d: str) -> DataFrame:
    moved = load(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", "l_partkey")
    pinned = load(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    classified = load(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return moved.join(pinned, "l_partkey", "left_semi").join(classified, "l_suppkey", "left_anti").select("l_suppkey", "l_partkey").distinct()


@query("actor_link_first", sql("call_sites", """SELECT target, source FROM (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY 'rel:' || substr(sha256(source || target), 1, 16), source) AS n FROM (SELECT DISTINCT target, source FROM call_sites)) WHERE n = 1"""))
def actor_link_first(spark: SparkSession, d: str) -> DataFrame:
    # Relationship ids are one prefix and 16 hex digits, and so are ordered as the number that these digits are.
    digits = F.substring(F.sha2(F.concat("source", "target"), 256), 1, 16)
    links = a.call_sites(spark, d).select("target", "source").withColumn("id", F.conv(digits, 16, 10).cast("decimal(20,0)"))
    return resolve.first_link(links, "target", "source", "id")


TOUCH = "touch AS (SELECT DISTINCT l_suppkey AS function, l_partkey AS location, l_returnflag = 'N' AS r FROM lineitem), links AS (SELECT s_suppkey AS source, s_suppkey * 7 % 100 + 1 AS target FROM supplier)"


def _touches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("l_returnflag") == "N"
    touched = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("function"), F.col("l_partkey").alias("location"), n.alias("reads"), (~n).alias("writes"))
    return touched, load(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") * 7 % 100 + 1).alias("target"))


@query("influence_data", f"""WITH {TOUCH} SELECT w.location, w.function AS writer, x.function AS reader FROM links JOIN touch w ON w.function = source AND NOT w.r JOIN touch x ON x.function = target AND x.r AND x.location = w.location WHERE source <> target""")
def influence_data(spark: SparkSession, d: str) -> DataFrame:
    return resolve.data_influence(*_touches(spark, d))


@query("influence_control", """SELECT o_custkey AS function, o_orderpriority AS condition, count(DISTINCT l_partkey) AS effects FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_returnflag <> 'N' GROUP BY 1, 2""")
def influence_control(spark: SparkSession, d: str) -> DataFrame:
    conditions = load(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("function"), F.col("o_orderpriority").alias("condition"))
    effects = load(spark, d, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return conditions.join(effects, "o_orderkey").groupBy("function", "condition").agg(F.count_distinct("l_partkey").alias("effects"))


@query("influence_call", f"""WITH {TOUCH} SELECT DISTINCT source, target, coalesce(n, 0) AS effects FROM links LEFT JOIN (SELECT function, count(*) AS n FROM touch WHERE NOT r AND function % 3 <> 0 GROUP BY function) ON function = target""")
def influence_call(spark: SparkSession, d: str) -> DataFrame:
    touched, links = _touches(spark, d)
    return resolve.call_influence(links, touched.where("writes and function % 3 <> 0").select("function", "location").distinct())


@query("ordered_hydration", """SELECT l_orderkey, string_agg(p_brand, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS brands FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def ordered_hydration(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_brand")))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda x: x["p_brand"]), ",").alias("brands"))
