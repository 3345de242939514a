"""Queries of the semantic layers and of the store, over orders as functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.operators import assets, execution, graph, holdings, semantic, store
from provloom.plans import adapters as a
from provloom.plans.adapters import sql
from provloom.plans.registry import query
from provloom.storage import load


def functions(spark: SparkSession, d: str) -> DataFrame:
    key = lambda p, c, s="": F.concat(F.lit(p), F.col(c).cast("string"), F.lit(s))
    gated = F.col("o_orderpriority").rlike("^[12]-")
    return load(spark, d, "orders").select(
        key("function:", "o_orderkey").alias("id"), key("contract:customer:", "o_custkey").alias("contract_id"), key("f", "o_orderkey").alias("name"), F.when(F.col("o_orderstatus") == "P", "payable").otherwise("nonpayable").alias("mutability"),
        F.when(gated, F.array("o_orderpriority")).otherwise(F.expr(semantic.EMPTY)).alias("modifiers"), key("c", "o_custkey", ".sol").alias("file"))


def relationships(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").withColumn("row", F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]))
    place = [F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file"), F.col("l_linenumber").cast("long").alias("line_start"), (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("long").alias("line_end")]
    source = F.concat(F.lit("function:"), F.col("l_orderkey").cast("string")).alias("source")
    access = lines.select(F.concat(F.lit("rel:a"), "row").alias("id"), F.when(F.col("l_returnflag") == "N", "READS").otherwise("WRITES").alias("type"), source, F.concat(F.lit("state:"), F.col("l_partkey").cast("string")).alias("target"), F.lit(None).cast("string").alias("call_kind"), *place)
    kind = F.when(F.col("l_linestatus") == "O", "external").when(F.col("l_returnflag") != "A", "internal")
    calls = lines.where("l_suppkey % 4 = 0").select(F.concat(F.lit("rel:c"), "row").alias("id"), F.lit("CALLS").alias("type"), source, F.concat(F.lit("function:"), (F.col("l_partkey") * 11).cast("string")).alias("target"), kind.alias("call_kind"), *place)
    return access.unionByName(calls)


def function_facts(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    predicate = F.when(e == "purchase", "WRITES").when(e == "view", "READS").when(e == "click", "CALLS").when(e == "signup", "EMITS").otherwise("USES")
    value = F.when(e == "click", F.element_at(F.array(F.lit("unresolved-lowlevel-call"), F.lit("unresolved-indirect-call"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int")))
    return load(spark, d, "events").select(
        F.concat(F.lit("fact:"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("function:"), (F.col("user_id") * 10 + F.col("event_id") % 10).cast("string")).alias("subject"), predicate.alias("predicate"), value.alias("value"),
        F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("file"), (F.col("event_id") % 50).alias("line_start"), (F.col("event_id") % 50).alias("line_end"))


def file_issues(spark: SparkSession, d: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    codes = F.array(F.when(F.col("c_acctbal") < 0, "compilation_failed"), F.when(segment == "BUILDING", "unsupported_assembly").when(segment == "MACHINERY", "call_target_unresolved").when(segment == "FURNITURE", "call_target_outside_source_set"))
    return load(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".sol")).alias("file"), F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("code"))


def states(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 10 == 0, "IOwnable").when(F.col("p_size") % 10 == 1, "IAdmin").when(F.col("p_size") % 10 == 2, "IGovernance").otherwise("uint256")
    return load(spark, d, "part").select(F.concat(F.lit("state:"), F.col("p_partkey").cast("string")).alias("id"), kind.alias("type"))


LAYERS = """fn AS (SELECT 'function:' || o_orderkey AS id, 'contract:customer:' || o_custkey AS contract_id, CASE WHEN o_orderstatus = 'P' THEN 'payable' ELSE 'nonpayable' END AS mutability,
        CASE WHEN regexp_matches(o_orderpriority, '^[12]-') THEN o_orderpriority ELSE '' END AS gate, 'c' || o_custkey || '.sol' AS file FROM orders),
    ln AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS r, 'o' || l_orderkey AS file, l_linenumber AS ls, l_linenumber + l_partkey % 3 AS le FROM lineitem),
    rel AS (SELECT 'rel:a' || r AS id, CASE WHEN l_returnflag = 'N' THEN 'READS' ELSE 'WRITES' END AS type, 'function:' || l_orderkey AS source, 'state:' || l_partkey AS target, NULL::VARCHAR AS call_kind, file, ls, le FROM ln
        UNION ALL SELECT 'rel:c' || r, 'CALLS', 'function:' || l_orderkey, 'function:' || (l_partkey * 11), CASE WHEN l_linestatus = 'O' THEN 'external' WHEN l_returnflag <> 'A' THEN 'internal' END, file, ls, le FROM ln WHERE l_suppkey % 4 = 0),
    fact AS (SELECT 'fact:' || event_id AS id, 'function:' || (user_id * 10 + event_id % 10) AS subject, event_type, CASE WHEN event_type = 'click' THEN CASE event_id % 3 WHEN 0 THEN 'lowlevel' WHEN 1 THEN 'indirect' END END AS mark, 'e' || user_id AS file, event_id % 50 AS ls FROM events),
    iss AS (SELECT 'c' || c_custkey || '.sol' AS file, c_acctbal < 0 AS dropped, c_mktsegment = 'BUILDING' AS assembly, c_mktsegment = 'MACHINERY' AS unresolved, c_mktsegment = 'FURNITURE' AS outside FROM customer),
    known AS (SELECT r.*, f.id IS NOT NULL AS known FROM rel r LEFT JOIN fn f ON f.id = r.target),
    eff AS (SELECT source AS id, file, ls, le, id AS tie, call_kind AS kind, CASE WHEN known THEN target ELSE '' END AS target FROM known WHERE type = 'CALLS' AND call_kind IS NOT NULL
        UNION ALL SELECT subject, file, ls, ls, id, mark, '' FROM fact WHERE mark IS NOT NULL),
    live AS (SELECT fn.*, 'semt:' || substr(sha256('{"contract_id":"' || contract_id || '","function_id":"' || id || '"}'), 1, 16) AS record, assembly, unresolved, outside, dropped FROM fn LEFT JOIN iss USING (file)),
    tr AS (SELECT record AS id, l.id AS function_id, l.contract_id, coalesce(reads, '') AS reads, coalesce(writes, '') AS writes, coalesce(effects, '') AS effects, impact, coalesce(obs, '') AS observations, CASE WHEN writes IS NULL THEN 'none' ELSE 'storage' END AS state_mutation,
            CASE WHEN mutability = 'payable' THEN 'payable' ELSE 'nonpayable' END AS value_handling, CASE WHEN assembly THEN 'assembly_skipped' ELSE '' END AS fidelity_flags, 1 + coalesce(n_rel, 0) + coalesce(n_fact, 0) AS n_basis
        FROM live l LEFT JOIN (SELECT source AS id, array_to_string(list_sort(list(DISTINCT target) FILTER (type = 'READS')), ',') AS reads, array_to_string(list_sort(list(DISTINCT target) FILTER (type = 'WRITES')), ',') AS writes, count(DISTINCT id) AS n_rel FROM rel GROUP BY 1) e ON e.id = l.id
        LEFT JOIN (SELECT id, string_agg(kind || '>' || target, '|' ORDER BY file, ls, le, tie, kind, target) AS effects, min(kind) AS impact FROM eff GROUP BY 1) x ON x.id = l.id
        LEFT JOIN (SELECT subject AS id, string_agg(id, ',' ORDER BY file, ls, id) FILTER (event_type = 'signup') AS obs, count(*) AS n_fact FROM fact GROUP BY 1) o ON o.id = l.id WHERE NOT dropped)"""


def _layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return semantic.state_transitions(functions(spark, d), relationships(spark, d), function_facts(spark, d), file_issues(spark, d))


@query("state_transitions", f"WITH {LAYERS} SELECT id, function_id, contract_id, reads, writes, effects, observations, state_mutation, value_handling, fidelity_flags, n_basis FROM tr")
def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    made = _layers(spark, d)[0]
    effects = F.array_join(F.transform("external_effects", lambda e: F.concat(e["call_kind"], F.lit(">"), F.coalesce(e["target_ref"], F.lit("")))), "|")
    return made.select("id", "function_id", "contract_id", F.array_join("reads", ",").alias("reads"), F.array_join("writes", ",").alias("writes"), effects.alias("effects"), F.array_join("observations", ",").alias("observations"),
                       "state_mutation", "value_handling", F.array_join("fidelity_flags", ",").alias("fidelity_flags"), F.size("basis").cast("long").alias("n_basis"))


@query("transition_unknowns", f"""WITH {LAYERS} SELECT record AS record_ref, 'fidelity_flags' AS field, 'unsupported_assembly' AS reason, id AS basis FROM live WHERE assembly AND NOT dropped
    UNION ALL SELECT id, 'transition', 'dropped_file', id FROM live WHERE dropped
    UNION ALL SELECT record, 'external_effects', reason, string_agg(DISTINCT b, ',' ORDER BY b) FROM (
        SELECT l.record, 'no_evidence' AS reason, k.id AS b FROM live l JOIN known k ON k.source = l.id WHERE NOT dropped AND type = 'CALLS' AND call_kind IS NULL
        UNION ALL SELECT l.record, 'out_of_scope_target', k.id FROM live l JOIN known k ON k.source = l.id WHERE NOT dropped AND type = 'CALLS' AND call_kind IS NOT NULL AND NOT known
        UNION ALL SELECT record, 'out_of_scope_target', id FROM live WHERE outside AND NOT dropped UNION ALL SELECT record, 'unresolved_call', id FROM live WHERE unresolved AND NOT dropped
        UNION ALL SELECT l.record, 'unresolved_call', f.id FROM live l JOIN fact f ON f.subject = l.id WHERE NOT dropped AND mark IS NOT NULL) GROUP BY record, reason""")
def transition_unknowns(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d)[1].withColumn("basis", F.array_join("basis", ","))


@query("authority_chains", f"""WITH {LAYERS},
    st AS (SELECT 'state:' || p_partkey AS id, CASE p_size % 10 WHEN 0 THEN 'IOwnable' WHEN 1 THEN 'IAdmin' WHEN 2 THEN 'IGovernance' ELSE 'uint256' END AS stype FROM part),
    act AS (SELECT target AS id, arg_min(source, r.id) AS actor FROM rel r WHERE type = 'CALLS' AND source IN (SELECT id FROM fn) GROUP BY target),
    rol AS (SELECT r.source AS id, CASE WHEN bool_or(stype = 'IOwnable') THEN 'owner' WHEN bool_or(stype = 'IAdmin') THEN 'admin' ELSE 'governance' END AS kind, arg_min(target, r.id) FILTER (type = 'WRITES') AS subject
        FROM rel r JOIN st ON st.id = r.target WHERE type IN ('READS', 'WRITES') AND stype <> 'uint256' GROUP BY 1)
    SELECT 'semau:' || substr(record, 6) AS chain_id, l.id AS function_id, coalesce(actor, 'unknown') AS actor, coalesce(kind, 'unknown') AS authority_kind, subject, CASE WHEN fidelity_flags = '' THEN tr.id END AS transition_id,
           coalesce(impact, 'unknown') AS impact, gate, CASE WHEN actor IS NULL THEN 'partial' ELSE 'complete' END AS status
    FROM live l LEFT JOIN act ON act.id = l.id LEFT JOIN rol ON rol.id = l.id LEFT JOIN tr ON tr.function_id = l.id""")
def authority_chains(spark: SparkSession, d: str) -> DataFrame:
    chains = semantic.authority_chains(functions(spark, d), relationships(spark, d), states(spark, d), _layers(spark, d)[0])
    return chains.withColumn("gate", F.array_join("gate", ","))


@query("upsert_patch", """SELECT coalesce(s.o_orderkey, p.o_orderkey) AS id, CASE WHEN p.o_orderkey IS NOT NULL THEN 'patched' ELSE s.o_orderstatus END AS status, CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderpriority ELSE p.o_orderpriority || '!' END AS priority
    FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) s FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) p ON s.o_orderkey = p.o_orderkey""")
def upsert_patch(spark: SparkSession, d: str) -> DataFrame:
    """Stored runs take the patch's status only; new runs come in whole."""
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    patch = rows.where("id % 2 = 0").select("id", F.lit("patched").alias("status"), F.concat("priority", F.lit("!")).alias("priority"))
    return store.upsert(rows.where("id % 3 <> 0"), patch, "id", ["status"])


@query("save_conflicts", """SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AND o_orderstatus = 'O'""")
def save_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Ids that a patch would store with other content."""
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    patch = rows.where("id % 2 = 0").withColumn("status", F.when(F.col("status") == "O", "X").otherwise(F.col("status")))
    return store.conflicting_rows(rows.where("id % 3 <> 0"), patch)


@query("context_bundle", sql("base_edges", """WITH near AS (SELECT 'contract:supplier:3' AS node, 'target' AS part UNION SELECT target, 'related' FROM base_edges WHERE source = 'contract:supplier:3' UNION SELECT source, 'related' FROM base_edges WHERE target = 'contract:supplier:3')
    SELECT node, part FROM near UNION ALL SELECT DISTINCT 'function:' || l_orderkey, 'caller' FROM lineitem WHERE l_suppkey = 3"""))
def context_bundle(spark: SparkSession, d: str) -> DataFrame:
    """What one entity is to be read with: itself, its neighbours and its callers."""
    root = spark.createDataFrame([("contract:supplier:3",)], "root string")
    related = graph.related_entities(a.base_edges(spark, d), root, 1).select("node", F.lit("related").alias("part"))
    callers = a.call_sites(spark, d).where("target = 'contract:supplier:3'").select(F.col("source").alias("node"), F.lit("caller").alias("part")).distinct()
    return root.select(F.col("root").alias("node"), F.lit("target").alias("part")).unionByName(related).unionByName(callers)


def asset_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Customers and nations as contracts, pinned signatures dealt to them by their keys, orders as variables."""
    customers = load(spark, d, "customer").select(F.concat(F.lit("contract:customer:"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("T"), (F.col("c_custkey") % 90).cast("string"), F.col("c_mktsegment")).alias("name"), F.col("c_custkey").alias("k"))
    nations = load(spark, d, "nation").select(F.concat(F.lit("contract:nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("k"))
    contracts = customers.unionByName(nations)
    signatures = F.array(*[F.struct(F.lit(s).alias("signature"), F.lit(k).alias("s")) for k, s in enumerate(SIGNATURES)])
    dealt = contracts.select("id", "k", F.explode(signatures).alias("x")).select("id", "k", "x.*").where((F.col("k") * 7 + F.col("s") * F.col("s")) % 5 < 2)
    functions_ = dealt.select(F.concat(F.lit("function:"), "id", F.lit(":"), "signature").alias("id"), F.col("id").alias("contract_id"), "signature")
    variables = load(spark, d, "orders").select(F.concat(F.lit("state:"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("contract:customer:"), F.col("o_custkey").cast("string")).alias("contract_id"),
                                                F.concat(F.lit("T"), (F.col("o_orderkey") % 90).cast("string"), F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("type"))
    return variables, contracts.select("id", "name"), functions_, a.base_edges(spark, d)


SIGNATURES = [s for names in assets.PINS.values() for s in names]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
DERIVED = f"""clo AS (SELECT id AS contract, id AS base FROM con UNION SELECT b.source, b.target FROM base_edges b JOIN con x ON x.id = b.source JOIN con y ON y.id = b.target),
    abi AS (SELECT DISTINCT contract, f.signature, f.family, f.id FROM clo JOIN fun f ON f.contract_id = clo.base),
    hit AS (SELECT contract, family FROM abi GROUP BY contract, family HAVING count(DISTINCT signature) = (SELECT count(*) FROM pins p WHERE p.family = abi.family)),
    one AS (SELECT contract, min(family) AS family FROM hit GROUP BY contract HAVING count(*) = 1),
    uni AS (SELECT name, min(id) AS id FROM con GROUP BY name HAVING count(*) = 1),
    ast AS (SELECT 'sema:' || substr(sha256('{{"contract_id":"' || contract_id || '","state_var_id":"' || v.id || '"}}'), 1, 16) AS asset_id, v.id AS state_var_id, contract_id, type AS name, coalesce(family, 'unknown') AS asset_type,
            2 + (SELECT count(*) FROM abi WHERE abi.contract = u.id) AS n_basis FROM var v JOIN uni u ON u.name = v.type LEFT JOIN one ON one.contract = u.id),
    tok AS (SELECT contract_id, min(asset_id) AS token FROM ast WHERE asset_type = 'erc20' GROUP BY contract_id HAVING count(*) = 1)"""
ASSETS = f"""pins(family, signature, s) AS (VALUES {', '.join(f"('{f}', '{s}', {SIGNATURES.index(s)})" for f, names in assets.PINS.items() for s in names)}),
    con AS (SELECT 'contract:customer:' || c_custkey AS id, 'T' || (c_custkey % 90) || c_mktsegment AS name, c_custkey::BIGINT AS k FROM customer UNION ALL SELECT 'contract:nation:' || n_nationkey, n_name, n_nationkey::BIGINT FROM nation),
    fun AS (SELECT 'function:' || id || ':' || signature AS id, id AS contract_id, signature, family FROM con JOIN pins ON (k * 7 + s * s) % 5 < 2),
    var AS (SELECT 'state:' || o_orderkey AS id, 'contract:customer:' || o_custkey AS contract_id, 'T' || (o_orderkey % 90) || ({SEGMENTS})[o_orderkey % 5 + 1] AS type FROM orders),
    {DERIVED}"""


@query("asset_classes", sql("base_edges", f"WITH {ASSETS} SELECT asset_id, state_var_id, name, asset_type, n_basis, CASE WHEN asset_type IN ('debt', 'collateral', 'reward', 'lp') THEN token END AS represents_asset_id FROM ast LEFT JOIN tok USING (contract_id)"))
def asset_classes(spark: SparkSession, d: str) -> DataFrame:
    made, _ = assets.assets(*asset_inputs(spark, d))
    return made.select("asset_id", "state_var_id", "name", "asset_type", F.size("basis").cast("long").alias("n_basis"), "represents_asset_id")


def holding_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Customers as contracts with one family each, nations as their bases with the balance function, orders as variables."""
    customers = load(spark, d, "customer").select(F.concat(F.lit("contract:customer:"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("name"), (F.col("c_custkey") % 6).alias("f"))
    nations = load(spark, d, "nation").select(F.concat(F.lit("contract:nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    pins = spark.createDataFrame([(f, x) for f, names in enumerate(assets.PINS.values()) for x in names], "f long, signature string")
    fns = customers.join(F.broadcast(pins), "f").select("id", "signature").unionByName(nations.select("id", F.lit(holdings.ENTITLEMENT).alias("signature")))
    variables = load(spark, d, "orders").select(F.concat(F.lit("state:"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("contract:customer:"), F.col("o_custkey").cast("string")).alias("contract_id"), F.concat(F.lit("T"), (F.col("o_orderkey") % 97 + 1).cast("string")).alias("type"))
    return variables, customers.select("id", "name").unionByName(nations), fns.select(F.concat(F.lit("function:"), "id", F.lit(":"), "signature").alias("id"), F.col("id").alias("contract_id"), "signature"), a.base_edges(spark, d)


def holding_uses(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' numbers as functions that read or write orders; seventh lines call a nation's balance function."""
    lines = load(spark, d, "lineitem")
    source = F.concat(F.lit("function:"), (F.col("l_suppkey") % 20).cast("string")).alias("source")
    access = lines.select(F.when(F.col("l_returnflag") == "N", "READS").otherwise("WRITES").alias("type"), source, F.concat(F.lit("state:"), F.col("l_orderkey").cast("string")).alias("target"))
    called = F.concat(F.lit("function:contract:nation:"), (F.col("l_partkey") % 25).cast("string"), F.lit(":balanceOf(address)"))
    return access.unionByName(lines.where("l_linenumber = 7").select(F.lit("CALLS").alias("type"), source, called.alias("target")))


HOLDINGS = f"""pins(family, signature, f) AS (VALUES {', '.join(f"('{n}', '{x}', {f})" for f, (n, names) in enumerate(assets.PINS.items()) for x in names)}),
    con AS (SELECT 'contract:customer:' || c_custkey AS id, 'T' || c_custkey AS name, c_custkey % 6 AS f FROM customer UNION ALL SELECT 'contract:nation:' || n_nationkey, n_name, NULL FROM nation),
    fun AS (SELECT 'function:' || id || ':' || signature AS id, id AS contract_id, signature, family FROM con JOIN pins USING (f) UNION ALL SELECT 'function:' || id || ':balanceOf(address)', id, 'balanceOf(address)', 'erc20' FROM con WHERE f IS NULL),
    var AS (SELECT 'state:' || o_orderkey AS id, 'contract:customer:' || o_custkey AS contract_id, 'T' || (o_orderkey % 97 + 1) AS type FROM orders),
    {DERIVED}"""
USES = """use AS (SELECT DISTINCT CASE WHEN l_returnflag = 'N' THEN 'READS' ELSE 'WRITES' END AS type, 'function:' || (l_suppkey % 20) AS source, 'state:' || l_orderkey AS target FROM lineitem
    UNION SELECT 'CALLS', 'function:' || (l_suppkey % 20), 'function:contract:nation:' || (l_partkey % 25) || ':balanceOf(address)' FROM lineitem WHERE l_linenumber = 7)"""


@query("accounting_pairs", sql("base_edges", f"""WITH {HOLDINGS}, {USES}, own AS (SELECT DISTINCT a.contract_id, a.asset_id, a.asset_type, u.source FROM ast a JOIN use u ON u.target = a.state_var_id WHERE u.type <> 'CALLS'),
    p AS (SELECT l.contract_id, 'debt_collateral' AS relation_kind, l.asset_id AS a, r.asset_id AS b, l.source FROM own l JOIN own r USING (contract_id, source) WHERE l.asset_type = 'debt' AND r.asset_type = 'collateral'
        UNION ALL SELECT l.contract_id, 'reserves_liquidity', l.asset_id, r.asset_id, l.source FROM own l JOIN own r USING (contract_id, source) WHERE l.asset_type = 'erc20' AND r.asset_type = 'lp')
    SELECT 'semacc:' || substr(sha256('{{"derivation":"paired-storage","endpoints":["' || least(a, b) || '","' || greatest(a, b) || '"],"relation_kind":"' || relation_kind || '"}}'), 1, 16) AS id, relation_kind, least(a, b) || ',' || greatest(a, b) AS endpoints,
        string_agg(DISTINCT source, ',' ORDER BY source) AS accessors FROM p GROUP BY contract_id, relation_kind, a, b"""))
def accounting_pairs(spark: SparkSession, d: str) -> DataFrame:
    made, _ = assets.assets(*holding_inputs(spark, d))
    found = holdings.accounting_pairs(made, holding_uses(spark, d).where("type <> 'CALLS'"))
    return found.select("id", "relation_kind", F.array_join("endpoints", ",").alias("endpoints"), F.array_join("accessors", ",").alias("accessors"))


@query("claims", sql("base_edges", f"""WITH {HOLDINGS}, {USES}, typ AS (SELECT a.*, u.id AS type_contract FROM ast a JOIN uni u ON u.name = a.name), bal AS (SELECT DISTINCT contract, id AS function FROM abi WHERE signature = 'balanceOf(address)'),
    rep AS (SELECT asset_id AS via, token AS claim_on, state_var_id, type_contract FROM typ JOIN tok USING (contract_id) WHERE asset_type IN ('debt', 'collateral', 'reward', 'lp') AND token IN (SELECT asset_id FROM typ WHERE type_contract IN (SELECT contract FROM bal))),
    found AS (SELECT source AS holder_ref, claim_on, via FROM rep JOIN use ON target = state_var_id AND type = 'READS' UNION SELECT source, claim_on, via FROM rep JOIN bal ON contract = type_contract JOIN use ON target = function AND type = 'CALLS')
    SELECT 'semcl:' || substr(sha256('{{"claim_on":"' || claim_on || '","holder_ref":"' || holder_ref || '","via":"' || via || '"}}'), 1, 16) AS id, holder_ref, claim_on, via FROM found"""))
def claims(spark: SparkSession, d: str) -> DataFrame:
    inputs = holding_inputs(spark, d)
    made, _ = assets.assets(*inputs)
    return holdings.claims(made, *inputs[1:], holding_uses(spark, d)).select("id", "holder_ref", "claim_on", "via")


@query("esm_accesses", f"""WITH {LAYERS}, g AS (SELECT target AS location, file || ':' || ls || '-' || le AS span, bool_or(type = 'READS') AS r, bool_or(type = 'WRITES') AS w, count(DISTINCT id) AS edges FROM rel WHERE type <> 'CALLS' GROUP BY 1, 2),
    o AS (SELECT *, CASE WHEN r AND w THEN 'readwrite' WHEN r THEN 'read' ELSE 'write' END AS op FROM g)
    SELECT 'seme:' || substr(sha256('{{"location":"' || location || '","op":"' || op || '","span":"' || span || '"}}'), 1, 16) AS id, location, span, op, edges FROM o""")
def esm_accesses(spark: SparkSession, d: str) -> DataFrame:
    return execution.state_accesses(relationships(spark, d)).select("id", "location", "span", "op", F.size("basis").cast("long").alias("edges"))


@query("esm_boundaries", f"""WITH {LAYERS}, s AS (SELECT DISTINCT id AS site, call_kind AS kind, CASE WHEN known THEN target ELSE 'unknown' END AS target FROM known WHERE type = 'CALLS' AND call_kind = 'external' UNION SELECT id, 'unresolved-' || mark || '-call', id FROM fact WHERE mark IS NOT NULL)
    SELECT 'seme:' || substr(sha256('{{"kind":"' || kind || '","site":"' || site || '","target":"' || target || '"}}'), 1, 16) AS id, site, kind, target FROM s""")
def esm_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return execution.external_boundaries(relationships(spark, d), functions(spark, d), function_facts(spark, d))


CONDITIONS = f"""WITH {LAYERS}, c AS (
    SELECT 'modifier-gate' AS kind, id AS function, gate AS descriptor, id AS ref FROM fn WHERE gate <> '' UNION ALL SELECT 'visibility-gate', id, CASE WHEN mutability = 'payable' THEN 'external' ELSE 'public' END, id FROM fn
    UNION ALL SELECT 'mutability-gate', id, mutability, id FROM fn
    UNION ALL SELECT 'unresolved-branch', subject, 'custom-error:E' || e.e, f.id FROM fact f JOIN (SELECT 'fact:' || event_id AS id, event_id % 4 AS e FROM events) e ON e.id = f.id WHERE event_type = 'error' AND e.e <> 0 AND subject IN (SELECT id FROM fn))"""


@query("esm_conditions", CONDITIONS + """ SELECT 'seme:' || substr(sha256('{"descriptor":"' || descriptor || '","function":"' || function || '","kind":"' || kind || '"}'), 1, 16) AS id, kind, function, descriptor,
    count(DISTINCT ref) FILTER (ref <> function) + 1 AS n_basis FROM c GROUP BY kind, function, descriptor""")
def esm_conditions(spark: SparkSession, d: str) -> DataFrame:
    fns = functions(spark, d).withColumn("visibility", F.when(F.col("mutability") == "payable", "external").otherwise("public"))
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 4
    used = function_facts(spark, d).withColumn("value", F.when(F.col("predicate") == "USES", F.when(number == 0, "custom-error:").otherwise(F.concat(F.lit("custom-error:E"), number.cast("string")))))
    return execution.conditions(fns, used).select("id", "kind", "function", "descriptor", F.size("basis").cast("long").alias("n_basis"))


@query("esm_temporals", """WITH o AS (SELECT l_partkey AS u, array_to_string(list_sort(list_distinct(list('function:' || l_suppkey))), '","') AS c, len(list_distinct(list(l_suppkey))) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT 'seme:' || substr(sha256('{"consumers":["' || c || '"],"kind":"unknown"}'), 1, 16) AS id, replace(c, '","', ',') AS consumers, any_value(n) + count(*) AS n_basis FROM o GROUP BY c""")
def esm_temporals(spark: SparkSession, d: str) -> DataFrame:
    """Uses of a builtin (parts) grouped by the suppliers that consume them."""
    uses = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("descriptor"), F.concat(F.lit("function:"), F.col("l_suppkey").cast("string")).alias("consumer"))
    return execution.temporal_sources(uses).select("id", F.array_join("consumers", ",").alias("consumers"), F.size("basis").cast("long").alias("n_basis"))
