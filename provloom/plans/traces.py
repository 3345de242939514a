"""Queries of lineage, fee surfaces, roles and normal forms, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.functions import text
from provloom.operators import aggregate, assets, documents, graph, holdings, lineage, resolve, trust
from provloom.plans import adapters as a
from provloom.plans.adapters import sql
from provloom.plans.registry import query
from provloom.storage import Scratch, load


def derivations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Derivations of up to ten documents each, and three runs of two source identities."""
    f = a.files(spark, d)
    run = F.concat(F.lit("run:"), (F.col("doc_id") % 3).cast("string"))
    ref = lambda kind, value: F.struct(F.lit(kind).alias("entity_type"), value.alias("entity_id"))
    made = f.groupBy(F.concat(F.floor(F.col("doc_id") / 10).cast("string"), F.lit("-"), (F.col("doc_id") % 3).cast("string")).alias("id"), run.alias("run_id")).agg(
        F.collect_list(ref("source_file", F.col("path"))).alias("inputs"), F.collect_list(ref("fact", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))).alias("outputs"),
        F.collect_set(F.concat("path", F.lit(":1-"), (F.col("doc_id") % 9).cast("string"))).alias("spans"))
    tens = F.split("id", "-")[0].cast("long")
    made = made.withColumns({"operation": F.when(tens % 2 == 0, "extract.calls").otherwise("extract.functions"), "operation_version": F.concat((tens % 3).cast("string"), F.lit(".0"))})
    runs = spark.createDataFrame([("run:0", "hash:0"), ("run:1", "hash:1"), ("run:2", "hash:0")], "id string, source_hash string")
    return made, runs


DERIVED = """de AS (SELECT doc_id, path, (doc_id // 10) || '-' || (doc_id % 3) AS id, 'hash:' || (doc_id % 3 % 2) AS hash, path || ':1-' || (doc_id % 9) AS span FROM files),
    back AS (SELECT DISTINCT 'entity|doc:' || doc_id AS source, 'derivation|' || id AS target FROM de UNION SELECT 'derivation|' || id, 'source_file|' || path FROM de UNION SELECT 'derivation|' || id, 'provenance_span|' || span FROM de
        UNION SELECT 'source_file|' || path, 'source_identity|' || hash FROM de UNION SELECT 'provenance_span|' || span, 'source_identity|' || hash FROM de
        UNION SELECT * FROM (VALUES ('source_identity|hash:0', 'run|run:0'), ('source_identity|hash:1', 'run|run:1'), ('source_identity|hash:0', 'run|run:2'))),
    forth AS (SELECT DISTINCT 'source_file|' || path AS source, 'derivation|' || id AS target FROM de UNION SELECT 'derivation|' || id, 'entity|doc:' || doc_id FROM de)"""
ENTITY_ROOTS = "roots AS (SELECT 'entity|doc:' || doc_id AS root FROM files UNION SELECT 'source_file|' || path FROM files)"


def _trace_roots(spark: SparkSession, d: str) -> DataFrame:
    f = a.files(spark, d)
    return f.select(F.concat(F.lit("entity|doc:"), F.col("doc_id").cast("string")).alias("root")).unionByName(f.select(F.concat(F.lit("source_file|"), "path").alias("root")))


@query("backward_trace_kinds", sql("files", f"""WITH {DERIVED}, {ENTITY_ROOTS}, walk AS (SELECT root, root AS node, 0 AS hop FROM roots UNION SELECT root, target, hop + 1 FROM walk JOIN back ON source = node WHERE hop < 4) SELECT root, node, min(hop) AS hop FROM walk GROUP BY root, node""", recursive=True))
def backward_trace_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What every entity and file was made of, over all five kinds of links."""
    return graph.reach(lineage.backward_edges(*derivations(spark, d)), _trace_roots(spark, d), 4)


@query("lineage_both_ways", sql("files", f"""WITH {DERIVED}, {ENTITY_ROOTS}, b AS (SELECT root, root AS node, 0 AS hop FROM roots UNION SELECT root, target, hop + 1 FROM b JOIN back ON source = node WHERE hop < 2), f AS (SELECT root, root AS node, 0 AS hop FROM roots UNION SELECT root, target, hop + 1 FROM f JOIN forth ON source = node WHERE hop < 2),
    mb AS (SELECT root, node, min(hop) AS hop FROM b GROUP BY root, node), mf AS (SELECT root, node, min(hop) AS hop FROM f GROUP BY root, node)
    SELECT root, node, 'backward' AS direction, hop FROM mb UNION ALL SELECT root, node, 'forward', hop FROM mf ANTI JOIN mb USING (root, node)""", recursive=True))
def lineage_both_ways(spark: SparkSession, d: str) -> DataFrame:
    made, runs = derivations(spark, d)
    roots = _trace_roots(spark, d)
    return lineage.both_directions(graph.reach(lineage.backward_edges(made, runs), roots, 2), graph.reach(lineage.forward_edges(made), roots, 2))


@query("entity_provenance", sql("files", f"""WITH {DERIVED} SELECT 'doc:' || x.doc_id AS entity_id, string_agg(DISTINCT y.span, ',' ORDER BY y.span) AS spans FROM de x JOIN de y USING (id) GROUP BY x.doc_id"""))
def entity_provenance(spark: SparkSession, d: str) -> DataFrame:
    return lineage.spans_of_entities(derivations(spark, d)[0]).withColumn("spans", F.array_join("spans", ","))


@query("derivations_of_entities", sql("files", f"""WITH {DERIVED} SELECT 'doc:' || doc_id AS entity_id, id AS derivation FROM de UNION SELECT path, id FROM de"""))
def derivations_of_entities(spark: SparkSession, d: str) -> DataFrame:
    return lineage.derivations_of_entities(derivations(spark, d)[0])


@query("derivations_by_version", sql("files", f"""WITH {DERIVED} SELECT DISTINCT id FROM de WHERE doc_id // 10 % 2 = 0 AND doc_id // 10 % 3 = 1"""))
def derivations_by_version(spark: SparkSession, d: str) -> DataFrame:
    return lineage.by_version(derivations(spark, d)[0], "extract.calls", "1.0").select("id")


HYDRATION = """WITH links AS (SELECT l_orderkey AS owner, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS position, l_partkey * 3 // 2 AS key FROM lineitem)"""


def _hydrated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    links = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("position"), F.floor(F.col("l_partkey") * 3 / 2).alias("key"))
    return lineage.hydrate(links, load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("value")))


@query("hydrated_links", HYDRATION + """ SELECT owner, string_agg(p_brand, ',' ORDER BY position, p_brand) AS "values" FROM links JOIN part ON p_partkey = key GROUP BY owner""")
def hydrated_links(spark: SparkSession, d: str) -> DataFrame:
    return _hydrated(spark, d)[0].withColumn("values", F.array_join("values", ","))


@query("hydration_missing", HYDRATION + " SELECT owner, position, key FROM links WHERE key NOT IN (SELECT p_partkey FROM part)")
def hydration_missing(spark: SparkSession, d: str) -> DataFrame:
    """Links whose record is not there."""
    return _hydrated(spark, d)[1]


def fee_inputs(spark: SparkSession, d: str):
    """Customers under their nations as contracts, orders as functions, parts as variables."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    contracts = load(spark, d, "customer").select(key("contract:customer:", "c_custkey").alias("id")).unionByName(load(spark, d, "nation").select(key("contract:nation:", "n_nationkey").alias("id")))
    signature = F.when(F.col("o_orderkey") % 5 == 0, assets.FEE_PINS[0]).otherwise("other()")
    functions = load(spark, d, "orders").select(key("function:", "o_orderkey").alias("id"), key("contract:customer:", "o_custkey").alias("contract_id"), signature.alias("signature"))
    links = a.base_edges(spark, d).select("type", "source", "target").unionByName(a.access_sites(spark, d).select("type", "source", "target"))
    held = load(spark, d, "customer").where("c_acctbal > 0").select(key("contract:customer:", "c_custkey").alias("contract_id"), key("sema:", "c_custkey").alias("asset_id"))
    return contracts, functions, links, load(spark, d, "part").select(key("state:", "p_partkey").alias("id")), held


@query("fee_split", sql("access_sites", """WITH fee AS (SELECT 'function:' || o_orderkey AS f, 'contract:customer:' || o_custkey AS contract FROM orders WHERE o_orderkey % 5 = 0),
    dest AS (SELECT DISTINCT contract, target FROM fee JOIN access_sites ON source = f WHERE type = 'WRITES' AND target IN (SELECT 'state:' || p_partkey FROM part)),
    several AS (SELECT contract, count(*) AS destinations FROM dest GROUP BY contract HAVING count(*) >= 2), touch AS (SELECT DISTINCT source AS f, target FROM access_sites),
    acc AS (SELECT contract, count(*) AS accessors FROM (SELECT contract, f FROM dest JOIN several USING (contract) JOIN touch USING (target) GROUP BY contract, f HAVING count(*) >= 2) GROUP BY contract)
    SELECT contract, 'sema:' || c_custkey AS endpoints, destinations, accessors FROM several JOIN acc USING (contract) JOIN customer ON contract = 'contract:customer:' || c_custkey WHERE c_acctbal > 0"""))
def fee_split(spark: SparkSession, d: str) -> DataFrame:
    return holdings.fee_split(*fee_inputs(spark, d)).withColumn("endpoints", F.array_join("endpoints", ","))


PINNED = {**assets.ROLE_PINS, **assets.DEPENDENCY_PINS}
ROLE_SIGNATURES = [(f, s) for f, names in PINNED.items() for s in names]


@query("role_surfaces", f"""WITH pins(family, signature, k) AS (VALUES {', '.join(f"('{f}', '{s}', {k})" for k, (f, s) in enumerate(ROLE_SIGNATURES))}),
    have AS (SELECT DISTINCT l_orderkey AS contract, signature FROM lineitem JOIN pins ON l_partkey % {len(ROLE_SIGNATURES)} = k),
    hit AS (SELECT contract, family FROM have JOIN pins USING (signature) GROUP BY contract, family HAVING count(*) = (SELECT count(*) FROM pins p WHERE p.family = pins.family))
    SELECT contract, coalesce(string_agg(family, ',' ORDER BY family), '') AS families FROM (SELECT DISTINCT l_orderkey AS contract FROM lineitem) LEFT JOIN hit USING (contract) GROUP BY contract""")
def role_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Which roles and dependencies each order's signatures show whole; parts stand for signatures."""
    names = F.array(*[F.lit(s) for _, s in ROLE_SIGNATURES])
    have = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("contract"), F.element_at(names, (F.col("l_partkey") % len(ROLE_SIGNATURES) + 1).cast("int")).alias("signature"))
    found = resolve.pin_hits(have, spark.createDataFrame(ROLE_SIGNATURES, "family string, signature string"))
    return found.select("contract", F.array_join(F.array_sort("families"), ",").alias("families"))


@query("normal_forms", r"""SELECT event_id, 'only' || event_id % 3 || '(a, b' || user_id || ')' AS modifier, CASE WHEN event_id % 4 = 1 THEN 'src/f' || event_id || '.sol' WHEN event_id % 4 = 2 THEN 'f' || event_id END AS literal,
    CASE WHEN event_id % 2 = 0 THEN '0.8.' || event_id % 30 || '+commit.' || lpad(user_id::VARCHAR, 8, '0') END AS version, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unknown' END AS visibility, event_id % 4 NOT IN (0, 3) AS safe FROM events""")
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Modifier texts, literal paths, compiler versions, unknown fall-backs and path shapes."""
    e = load(spark, d, "events")
    n, u = F.col("event_id"), F.col("user_id")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    pattern = F.when(n % 4 == 0, s("../f", n)).when(n % 4 == 1, s("./src\\f", n, ".sol")).when(n % 4 == 2, s("f", n)).otherwise(s("/src/*", n))
    path = F.when(n % 4 == 0, s("a/../f", n)).when(n % 4 == 3, s("/f", n)).otherwise(s("a/f", n))
    build = F.when(n % 2 == 0, s("soljson-v0.8.", n % 30, "+commit.", F.lpad(u.cast("string"), 8, "0"), ".js")).otherwise(s("soljson-", n))
    return e.select("event_id", text.modifier_text(s("  only", n % 3), s(" a, \n b", u, " ")).alias("modifier"), text.literal_path(pattern).alias("literal"), text.long_version(build).alias("version"), text.known_or_unknown(F.col("event_type"), ["view", "click"]).alias("visibility"), text.safe_path(path).alias("safe"))


@query("artifact_hashes", sql("base_edges facts files", """SELECT 'edges' AS kind, count(*) AS rows, sha256(string_agg(type || '|' || source || '|' || target, chr(10) ORDER BY type || '|' || source || '|' || target)) AS hash FROM base_edges
    UNION ALL SELECT 'facts', count(*), sha256(string_agg(seq || ' ' || subject || ' ' || predicate, chr(10) ORDER BY seq::VARCHAR)) FROM facts UNION ALL SELECT 'sources', count(*), sha256(string_agg(path || ':' || sha256, chr(10) ORDER BY path)) FROM files"""))
def artifact_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Records of an artifact and its sources, each kind with the exact hash of its sorted lines."""
    text = lambda c: F.col(c).cast("string")
    edges, facts, files = a.base_edges(spark, d), a.facts(spark, d), a.files(spark, d)
    tables = {
        "edges": edges.select(F.concat_ws("|", "type", "source", "target").alias("key"), F.concat_ws("|", "type", "source", "target").alias("line")),
        "facts": facts.select(text("seq").alias("key"), F.concat_ws(" ", text("seq"), text("subject"), "predicate").alias("line")),
        "sources": files.select(F.col("path").alias("key"), F.concat_ws(":", "path", "sha256").alias("line")),
    }
    return spark.createDataFrame([(kind, df.count(), documents.lines_hash(df, Scratch(spark, "hashes"))) for kind, df in tables.items()], "kind string, rows long, hash string")


KIND_PINS = [(f, x) for f in trust.KINDS for x in assets.DEPENDENCY_PINS[f]]
_SIGNATURES = [x for _, x in KIND_PINS] + ["transfer(address)", "hook(bytes)"]
TRUST = f"""WITH fn AS (SELECT 'function:' || o_orderkey AS id, 'c' || o_custkey AS contract_id, 'f' || o_orderkey % 40 AS name, {_SIGNATURES!r}[o_orderkey // 4 % {len(_SIGNATURES)} + 1] AS signature, o_orderstatus = 'P' AS open_, o_orderkey % 3 = 0 AS takes FROM orders),
    ct AS (SELECT 'c' || c_custkey AS id, 'C' || c_custkey % 700 AS name, c_custkey % 40 = 0 AS interface FROM customer WHERE c_custkey % 11 <> 0),
    imp AS (SELECT 'c' || c_custkey AS source, 'c' || c_custkey * 2 AS target FROM customer WHERE c_custkey % 60 = 0),
    eff AS (SELECT 'semt:' || l_orderkey AS t, l_linenumber AS place, CASE WHEN l_partkey % 10 = 0 THEN 'state:' || l_partkey ELSE 'function:' || (l_partkey * 4 + l_suppkey % 4) END AS target, 'rel:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS basis FROM lineitem),
    tf AS (SELECT DISTINCT 'semt:' || o_orderkey AS t, 'function:' || o_orderkey AS f, 'fact:' || event_id AS fact FROM orders LEFT JOIN events ON event_type = 'signup' AND user_id * 20 + event_id % 20 = o_orderkey),
    known AS (SELECT fn.id AS target, 'external:' || ct.name AS dep_key, ct.name AS name, signature AS capability, true AS called FROM fn JOIN ct ON ct.id = contract_id UNION ALL SELECT 'state:' || p_partkey, 'statevar:s' || p_partkey % 50, 's' || p_partkey % 50, 'statevar:s' || p_partkey % 50, false FROM part),
    met AS (SELECT eff.*, dep_key, name, capability, called FROM eff LEFT JOIN known USING (target)),
    hooked AS (SELECT DISTINCT source FROM imp JOIN ct i ON i.id = target AND i.interface JOIN ct s ON s.id = source),
    surface AS (SELECT fn.*, CASE WHEN EXISTS (SELECT 1 FROM hooked WHERE source <> contract_id) THEN 'consumed' ELSE 'unknown' END AS direction FROM fn WHERE open_ AND takes),
    rows AS (SELECT dep_key, name, 'observed' AS direction, capability, (t, place) AS seen, basis, t, called FROM met WHERE dep_key IS NOT NULL
        UNION ALL SELECT 'callback:' || contract_id || ':' || name, 'callback:' || name, direction, signature, (id, 0), id, tf.t, false FROM surface LEFT JOIN (SELECT DISTINCT t, f FROM tf) tf ON tf.f = id),
    pins(family, signature, k) AS (VALUES {', '.join(f"('{f}', '{x}', {trust.KINDS.index(f)})" for f, x in KIND_PINS)}),
    dep AS (SELECT 'semdep:' || substr(sha256('{{"dep_key":"' || dep_key || '","dependency_type":"' || kind || '","name":"' || name || '"}}'), 1, 16) AS id, * FROM (SELECT dep_key, name, calls, CASE WHEN called THEN coalesce(family, 'unknown') ELSE 'unknown' END AS kind
        FROM (SELECT dep_key, name, arg_min(capability, seen) AS f, bool_or(called) AS called, count(*) AS calls FROM rows GROUP BY 1, 2) LEFT JOIN pins ON signature = f)),
    full_ AS (SELECT rows.*, dep.id AS dependency FROM rows JOIN dep USING (dep_key)),
    links AS (SELECT DISTINCT dependency, direction, basis FROM full_),
    listed AS (SELECT dependency, direction, list(capability ORDER BY began, capability) AS caps FROM (SELECT dependency, direction, capability, min(seen) AS began FROM full_ GROUP BY 1, 2, 3) GROUP BY 1, 2),
    facts AS (SELECT dependency, direction, list_sort(list(DISTINCT fact)) AS facts FROM (SELECT DISTINCT dependency, direction, t FROM full_) JOIN tf USING (t) WHERE fact IS NOT NULL GROUP BY 1, 2),
    said AS (SELECT *, 'semobs:' || substr(sha256('{{"based_on":[' || CASE WHEN len(based_on) = 0 THEN '' ELSE '"' || array_to_string(based_on, '","') || '"' END || '],"statement":"' || statement || '"}}'), 1, 16) AS obs
        FROM (SELECT dependency, direction, caps, coalesce(facts, []) AS based_on, 'Observed ' || direction || ' capability on ' || dependency || ' via ' || array_to_string(caps, ', ') AS statement FROM listed LEFT JOIN facts USING (dependency, direction))),
    held AS (SELECT *, 'semasm:' || substr(sha256('{{"based_on":["' || obs || '"],"statement":"' || trusted || '"}}'), 1, 16) AS asm, 'semtc:' || substr(sha256('{{"capabilities":["' || array_to_string(list_sort(caps), '","') || '"],"dependency_ref":"' || dependency || '","direction":"' || direction || '"}}'), 1, 16) AS cap
        FROM (SELECT *, 'Trust assumption for ' || direction || ' capability on ' || dependency || ': the external dependency behaves as expected for ' || array_to_string(caps, ', ') AS trusted FROM said))"""


def _trust(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Lines as calls of orders, which stand for functions with pinned and other signatures, or of parts as state variables."""
    key = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    signature = F.element_at(F.array(*map(F.lit, _SIGNATURES)), (F.floor(F.col("o_orderkey") / 4) % len(_SIGNATURES) + 1).cast("int"))
    functions = o.select(key("function:", F.col("o_orderkey")).alias("id"), key("c", F.col("o_custkey")).alias("contract_id"), key("f", F.col("o_orderkey") % 40).alias("name"), signature.alias("signature"),
                         F.when(F.col("o_orderstatus") == "P", "public").otherwise("internal").alias("visibility"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("uint256"), F.lit("bytes32"))).otherwise(F.array(F.lit("uint256"))).alias("parameters"))
    contracts = c.where("c_custkey % 11 <> 0").select(key("c", F.col("c_custkey")).alias("id"), key("C", F.col("c_custkey") % 700).alias("name"), F.when(F.col("c_custkey") % 40 == 0, "interface").otherwise("contract").alias("contract_type"))
    implements = c.where("c_custkey % 60 = 0").select(key("c", F.col("c_custkey")).alias("source"), key("c", F.col("c_custkey") * 2).alias("target"))
    states = load(spark, d, "part").select(key("state:", F.col("p_partkey")).alias("id"), key("s", F.col("p_partkey") % 50).alias("name"))
    row = F.concat_ws("-", *[F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    target = F.when(F.col("l_partkey") % 10 == 0, key("state:", F.col("l_partkey"))).otherwise(key("function:", F.col("l_partkey") * 4 + F.col("l_suppkey") % 4))
    effects = load(spark, d, "lineitem").select(key("semt:", F.col("l_orderkey")).alias("transition_id"), F.col("l_linenumber").cast("int").alias("place"), target.alias("target_ref"), F.array(F.concat(F.lit("rel:"), row)).alias("basis"))
    events = load(spark, d, "events").where("event_type = 'signup'").select((F.col("user_id") * 20 + F.col("event_id") % 20).alias("o_orderkey"), key("fact:", F.col("event_id")).alias("fact"))
    facts = o.select("o_orderkey").join(events, "o_orderkey", "left").select(key("semt:", F.col("o_orderkey")).alias("transition_id"), key("function:", F.col("o_orderkey")).alias("function_id"), "fact").distinct()
    return trust.trust_model(effects, functions, contracts, states, implements, facts, assets.DEPENDENCY_PINS)


@query("trust_drafts", TRUST + " SELECT id, dep_key, name, kind AS dependency_type, calls FROM dep")
def trust_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies on called contracts, state variables and callbacks."""
    return _trust(spark, d)["dependencies"]


@query("trust_capabilities", TRUST + " SELECT cap AS id, dependency, direction, array_to_string(list_sort(caps), ',') AS capabilities, asm AS trust_assumption_ref FROM held")
def trust_capabilities(spark: SparkSession, d: str) -> DataFrame:
    return _trust(spark, d)["capabilities"].withColumn("capabilities", F.array_join("capabilities", ","))


@query("trust_basis_links", TRUST + " SELECT dependency, direction, basis FROM links")
def trust_basis_links(spark: SparkSession, d: str) -> DataFrame:
    return _trust(spark, d)["links"]


@query("trust_observations", TRUST + " SELECT obs AS id, statement, array_to_string(based_on, ',') AS based_on FROM said")
def trust_observations(spark: SparkSession, d: str) -> DataFrame:
    return _trust(spark, d)["observations"].withColumn("based_on", F.array_join("based_on", ","))


@query("trust_assumptions", TRUST + " SELECT asm AS id, trusted AS statement, obs AS based_on FROM held")
def trust_assumptions(spark: SparkSession, d: str) -> DataFrame:
    return _trust(spark, d)["assumptions"].withColumn("based_on", F.array_join("based_on", ","))


@query("trust_unknowns", TRUST + """ SELECT t AS record_ref, 'external_effects' AS field, 'out_of_scope_target' AS reason, basis FROM met WHERE dep_key IS NULL UNION ALL SELECT id, 'direction', 'no_evidence', id FROM surface WHERE direction = 'unknown'
    UNION ALL SELECT cap, 'failure_semantics', 'no_evidence', (SELECT string_agg(basis, ',' ORDER BY basis) FROM links l WHERE l.dependency = held.dependency AND l.direction = held.direction) FROM held""")
def trust_unknowns(spark: SparkSession, d: str) -> DataFrame:
    """Targets out of scope, callbacks of unknown direction, and how each capability fails."""
    return _trust(spark, d)["unknowns"].withColumn("basis", F.array_join("basis", ","))
