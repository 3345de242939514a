"""Queries of integrity rules, trust and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.functions.canonical import content_id
from provloom.operators import trust
from provloom.plans import adapters as a
from provloom.plans import semantics as m
from provloom.plans.adapters import sql
from provloom.plans.registry import query
from provloom.storage import load


@query("id_tamper_check", sql("base_edges", """SELECT source, target, stored FROM (SELECT *, 'rel:' || substr(sha256('{"source_id":"' || source || '","target_id":"' || CASE WHEN seq % 17 = 0 THEN target || 'x' ELSE target END || '","type":"' || type || '"}'), 1, 16) AS stored,
    'rel:' || substr(sha256('{"source_id":"' || source || '","target_id":"' || target || '","type":"' || type || '"}'), 1, 16) AS expected FROM base_edges) WHERE stored <> expected"""))
def id_tamper_check(spark: SparkSession, d: str) -> DataFrame:
    """Records whose stored id is not that of their content; every 17th was changed."""
    ident = lambda target: content_id("rel", type=F.col("type"), source_id=F.col("source"), target_id=target)
    changed = F.when(F.col("seq") % 17 == 0, F.concat("target", F.lit("x"))).otherwise(F.col("target"))
    return a.base_edges(spark, d).withColumn("stored", ident(changed)).where(F.col("stored") != ident(F.col("target"))).select("source", "target", "stored")


@query("provenance_rules", """SELECT event_id, CASE WHEN kind = 'source_code' AND file IS NULL THEN 'file' WHEN kind = 'onchain' AND chain IS NULL THEN 'chain_id' WHEN kind = 'repository' AND file IS NULL AND chain IS NULL THEN 'repository' END AS missing FROM (
    SELECT event_id, CASE event_type WHEN 'view' THEN 'source_code' WHEN 'purchase' THEN 'onchain' WHEN 'click' THEN 'repository' ELSE 'other' END AS kind, CASE WHEN user_id % 3 <> 0 THEN 'f' || user_id END AS file, CASE WHEN event_id % 4 <> 0 THEN 'c' END AS chain FROM events)
    WHERE (kind = 'source_code' AND file IS NULL) OR (kind = 'onchain' AND chain IS NULL) OR (kind = 'repository' AND file IS NULL AND chain IS NULL)""")
def provenance_rules(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "view", "source_code").when(e == "purchase", "onchain").when(e == "click", "repository").otherwise("other")
    rows = load(spark, d, "events").select("event_id", kind.alias("source_type"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("f"), F.col("user_id").cast("string"))).alias("file"), F.when(F.col("event_id") % 4 != 0, "c").alias("chain_id"))
    rules = {"source_code": [["file"]], "onchain": [["chain_id"]], "repository": [["file", "chain_id"]]}
    return trust.missing_fields(rows, rules, {"repository": "repository"}).select("event_id", "missing")


TRUST = f"""WITH {m.LAYERS}, dep AS (SELECT k.source, k.target, k.call_kind, 'external:' || CASE WHEN f.contract_id IS NULL THEN 'unknown' ELSE f.contract_id END AS dependency, k.file, k.ls, k.le, k.id
    FROM known k LEFT JOIN fn f ON f.id = k.target WHERE k.type = 'CALLS' AND k.call_kind IS NOT NULL)"""


@query("trust_dependencies", TRUST + """ SELECT dependency, count(*) AS calls, count(DISTINCT source) AS callers, arg_min(call_kind, (file, ls, le, id, call_kind)) AS first_kind FROM dep GROUP BY dependency""")
def trust_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """What is called outside, by the contract that owns the target; its kind is that of the first call seen."""
    return trust.dependencies(m.relationships(spark, d), m.functions(spark, d))


PARAMETERS = ["address", "uint256", "bytes32", "string calldata", ""]
VISIBILITIES = {"F": "public", "O": "external", "P": "internal"}
SURFACE = f"""WITH impl AS (SELECT DISTINCT 'contract:customer:' || c_custkey AS contract FROM customer WHERE c_custkey = 7),
    surf AS (SELECT 'function:' || o_orderkey AS id, 'contract:customer:' || o_custkey AS contract_id FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 5 IN (0, 2, 3)),
    dir AS (SELECT id AS function_id, CASE WHEN EXISTS (SELECT 1 FROM impl WHERE contract <> surf.contract_id) THEN 'consumed' ELSE 'unknown' END AS direction FROM surf)"""


def _callbacks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as functions; one customer implements an interface."""
    orders = load(spark, d, "orders")
    visibility = F.coalesce(*[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in VISIBILITIES.items()])
    functions = orders.select(F.concat(F.lit("function:"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("contract:customer:"), F.col("o_custkey").cast("string")).alias("contract_id"), visibility.alias("visibility"), F.array(F.element_at(F.array(*map(F.lit, PARAMETERS)), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("parameters"))
    implementers = load(spark, d, "customer").where("c_custkey = 7").select(F.concat(F.lit("contract:customer:"), F.col("c_custkey").cast("string")).alias("contract"))
    return trust.callbacks(functions, implementers)


@query("callback_surface", SURFACE + " SELECT function_id, direction FROM dir")
def callback_surface(spark: SparkSession, d: str) -> DataFrame:
    """Open functions that take addresses or bytes, and whether any contract but their own implements an interface."""
    return _callbacks(spark, d)[0]


@query("callback_unknowns", SURFACE + " SELECT function_id AS record_ref, 'direction' AS field, 'no_evidence' AS reason, function_id AS basis FROM dir WHERE direction = 'unknown'")
def callback_unknowns(spark: SparkSession, d: str) -> DataFrame:
    return _callbacks(spark, d)[1].withColumn("basis", F.array_join("basis", ","))


@query("remapped_imports", """SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN 'lib/www/' || substr(url, 13) WHEN starts_with(url, 'https://') THEN 'lib/' || substr(url, 9) ELSE url END AS path FROM pages""")
def remapped_imports(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", trust.remapped(F.col("url"), ["https://www.=lib/www/", "https://=lib/"]).alias("path"))


@query("runs_by_source_identity", sql("files", """SELECT sha256 AS source_hash, string_agg('run:' || doc_id, ',' ORDER BY doc_id) AS runs FROM files WHERE sha256 IS NOT NULL GROUP BY 1"""))
def runs_by_source_identity(spark: SparkSession, d: str) -> DataFrame:
    """Runs by each source hash."""
    runs = a.files(spark, d).select("doc_id", F.col("sha256").alias("source_hash"))
    listed = F.array_sort(F.collect_list("doc_id"))
    return runs.where("source_hash is not null").groupBy("source_hash").agg(F.array_join(F.transform(listed, lambda x: F.concat(F.lit("run:"), x.cast("string"))), ",").alias("runs"))
