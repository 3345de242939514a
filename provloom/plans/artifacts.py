"""Queries of influence, stages, status, meta values and artifacts' lines, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.operators import artifacts, records, scope
from provloom.plans import adapters as a
from provloom.plans import semantics as m
from provloom.plans.adapters import sql
from provloom.plans.registry import query
from provloom.storage import load


def influence_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accesses, gates and calls; lines of one part within ten orders stand in one span, so that functions share accesses."""
    r, functions = m.relationships(spark, d), m.functions(spark, d)
    order = F.substring_index("source", ":", -1).cast("long")
    shared = r.where("type <> 'CALLS'").withColumn("file", F.concat(F.lit("o"), F.floor(order / 1000).cast("string"))).withColumn("line_start", F.lit(1)).withColumn("line_end", F.lit(9))
    conditions = functions.where(F.size("modifiers") > 0).select(F.concat(F.lit("cond:"), "id").alias("id"), F.col("id").alias("function"), F.array("id").alias("basis"))
    ids = functions.select("id")
    calls = r.where("type = 'CALLS'").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select("id", "source", "target")
    return artifacts.attributed_accesses(shared, functions), conditions, calls


INFLUENCE = f"""WITH {m.LAYERS}, whole AS (SELECT target AS loc, split_part(source, ':', 2)::BIGINT // 1000 AS place, coalesce(list_sort(list(DISTINCT rel.id) FILTER (type = 'WRITES')), []) AS w, coalesce(list_sort(list(DISTINCT rel.id) FILTER (type = 'READS')), []) AS r, list(DISTINCT source) AS owners
        FROM rel JOIN fn ON fn.id = source WHERE type <> 'CALLS' GROUP BY 1, 2),
    acc AS (SELECT unnest(owners) AS f, loc, w, r FROM whole), call AS (SELECT k.id, source, target FROM known k JOIN fn ON fn.id = source WHERE type = 'CALLS' AND known),
    inf AS (SELECT 'data-supported' AS kind, 'state-version:' || x.loc || '@' || source AS f, 'state-version:' || y.loc || '@' || target AS t, list_sort(x.w || y.r || [call.id]) AS e, [x.loc, source, target] || x.w || y.r || [call.id] AS b FROM call JOIN acc x ON x.f = source AND len(x.w) > 0 JOIN acc y ON y.f = target AND len(y.r) > 0 AND y.loc = x.loc WHERE source <> target
        UNION ALL SELECT 'control-supported', 'gate:cond:' || fn.id, 'state-version:' || loc || '@' || fn.id, list_sort(['cond:' || fn.id] || w || r), w || r || [fn.id, loc] FROM fn JOIN acc ON acc.f = fn.id WHERE gate <> ''
        UNION ALL SELECT 'call-supported', 'call-site:' || call.id, 'state-version:' || loc || '@' || target, list_sort([call.id] || w || r), [call.id, loc, source, target] || w || r FROM call JOIN acc ON acc.f = target)"""


@query("influence_records", INFLUENCE + """ SELECT DISTINCT 'seme:' || substr(sha256('{"evidence":["' || array_to_string(e, '","') || '"],"from":"' || f || '","kind":"' || kind || '","to":"' || t || '"}'), 1, 16) AS id, kind, f AS from_ref, t AS to_ref, array_to_string(e, ',') AS evidence, array_to_string(list_sort(list_distinct(b)), ',') AS basis FROM inf""")
def influence_records(spark: SparkSession, d: str) -> DataFrame:
    """How what one function does bears on another, with the evidence of the accesses concerned."""
    # No access has more functions than lines.
    return artifacts.influences(*influence_inputs(spark, d), rows=load(spark, d, "lineitem").count()).withColumn("evidence", F.array_join("evidence", ",")).withColumn("basis", F.array_join("basis", ","))


@query("influence_unknowns", INFLUENCE + """ SELECT 'seme:' || substr(sha256('{"basis":["' || id || '"],"reason":"no_evidence","scope":"influence-arg-param"}'), 1, 16) AS id, 'influence-arg-param' AS scope, 'no_evidence' AS reason, id AS basis FROM call WHERE target NOT IN (SELECT f FROM acc)""")
def influence_unknowns(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose callee touches no known location."""
    accesses, _, calls = influence_inputs(spark, d)
    return records.unknowns(artifacts.silent_calls(calls, accesses)).withColumn("basis", F.array_join("basis", ","))


CODES = ["NoSourcesFound", "CompilationFailed", "RootEscape", "InvalidReconState", "CompilerUnavailable"]


@query("error_stages", f"""SELECT event_id, CASE ({CODES})[event_id % 5 + 1] WHEN 'InvalidReconState' THEN 'analysis' WHEN 'NoSourcesFound' THEN 'discover' WHEN 'RootEscape' THEN 'discover' ELSE 'compile' END AS stage,
    CASE WHEN event_id % 2 = 0 THEN event_type ELSE '[Other] ' || event_type END AS message FROM events WHERE event_type = 'error'""")
def error_stages(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("event_id") % 5 + 1).cast("int"))
    message = F.concat(F.lit("["), F.when(F.col("event_id") % 2 == 0, code).otherwise("Other"), F.lit("] "), "event_type")
    return load(spark, d, "events").where("event_type = 'error'").select("event_id", artifacts.stage_of(code).alias("stage"), artifacts.message_without_code(code, message).alias("message"))


@query("model_status", sql("entries", """SELECT 'PARTIAL' AS status, count(DISTINCT status || path) + 1 AS degradation FROM entries WHERE status IN ('UNRESOLVED', 'UNSUPPORTED')"""))
def model_status(spark: SparkSession, d: str) -> DataFrame:
    rows = scope.entries(scope.inventory(a.files(spark, d), ["**/*"], a.EXCLUDES, a.LIMIT_BYTES), a.issues(spark, d), scope.not_found(a.literals(spark, d), a.files(spark, d)))
    return artifacts.model_status(rows, syntactic=True)


@query("meta_upsert", """SELECT coalesce(p.key, s.key) AS key, coalesce(p.value, s.value) AS value FROM (SELECT c_custkey AS key, c_mktsegment AS value FROM customer) s FULL JOIN (SELECT o_custkey + 500 AS key, arg_max(o_orderpriority, (o_orderkey, o_orderpriority)) AS value FROM orders GROUP BY 1) p ON p.key = s.key""")
def meta_upsert(spark: SparkSession, d: str) -> DataFrame:
    stored = load(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    patches = load(spark, d, "orders").select((F.col("o_custkey") + 500).alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    return artifacts.latest_meta(stored, patches)


@query("artifact_lines", """SELECT 'contracts' AS kind, 'contract:customer:' || c_custkey AS id, '{"id":"contract:customer:' || c_custkey || '","name":"' || c_name || '"}' AS json FROM customer
    UNION ALL SELECT 'functions', 'function:' || o_orderkey, '{"contract_id":"contract:customer:' || o_custkey || '","id":"function:' || o_orderkey || '","modifiers":[' || CASE WHEN o_orderstatus = 'P' THEN '"gate"' ELSE '' END || ']}' FROM orders""")
def artifact_lines(spark: SparkSession, d: str) -> DataFrame:
    """Contracts and functions as the canonical lines of one document."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    contracts = load(spark, d, "customer").select(key("contract:customer:", "c_custkey").alias("id"), F.col("c_name").alias("name"))
    gates = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("gate"))).otherwise(F.array().cast("array<string>"))
    functions = load(spark, d, "orders").select(key("function:", "o_orderkey").alias("id"), key("contract:customer:", "o_custkey").alias("contract_id"), gates.alias("modifiers"))
    return artifacts.canonical_lines({"contracts": contracts, "functions": functions})


@query("unknown_keys", """SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x <> 'k')), ',') AS extra FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '{"z":1,"k":2,"a":3}' ELSE props END AS props FROM events) WHERE len(list_filter(json_keys(props), lambda x: x <> 'k')) > 0""")
def unknown_keys(spark: SparkSession, d: str) -> DataFrame:
    """Events whose properties have keys that the schema does not know; every ninth is given two."""
    rows = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, '{"z":1,"k":2,"a":3}').otherwise(F.col("props")).alias("props"))
    return artifacts.unknown_keys(rows, "event_id", "props", ["k"]).withColumn("extra", F.array_join("extra", ","))
