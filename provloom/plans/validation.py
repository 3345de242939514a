"""Queries of the validators over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.operators import order, scope, state_check, validation
from provloom.plans import adapters as a
from provloom.plans.adapters import sql
from provloom.plans.registry import query
from provloom.storage import load

KINDS = ["fact", "observation", "assumption", "hypothesis", "evidence"]


def epistemic_records(spark: SparkSession, d: str) -> DataFrame:
    """Events as records, each based on the one before it unless its user is a multiple of 7."""
    e = load(spark, d, "events")
    k = (F.col("event_id") % 5).cast("int")
    name = lambda k, n: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), k + 1), F.lit(":"), n.cast("string"))
    before = F.filter(F.array(F.when(F.col("user_id") % 7 != 0, name(F.greatest(k - 1, F.lit(0)), F.col("event_id") - 1))), lambda x: x.isNotNull())
    empty = F.array().cast("array<string>")
    levels = F.element_at(F.array(*map(F.lit, [*validation.CONFIDENCE.values(), "VERIFIED"])), k + 1)
    return e.select(
        F.element_at(F.array(*map(F.lit, KINDS)), k + 1).alias("kind"), name(k, F.col("event_id")).alias("id"), F.when(F.col("event_id") % 11 == 0, "SPECULATIVE").otherwise(levels).alias("level"),
        F.when(k.isin(1, 2, 3), before).otherwise(empty).alias("based_on"), F.array_repeat(F.lit("p"), (F.col("user_id") % 4).cast("int")).alias("provenance"),
        F.when((k == 4) & (F.col("event_type") != "error"), before).otherwise(empty).alias("supports"), F.when((k == 4) & (F.col("event_type") == "error"), before).otherwise(empty).alias("contradicts"))


RECORDS = f"""rec AS (SELECT event_id, event_type, user_id, event_id % 5 AS k, ({KINDS})[event_id % 5 + 1] AS kind, ({KINDS})[event_id % 5 + 1] || ':' || event_id AS id,
    CASE WHEN event_id % 11 = 0 THEN 'SPECULATIVE' ELSE ({[*validation.CONFIDENCE.values(), 'VERIFIED']})[event_id % 5 + 1] END AS level,
    CASE WHEN user_id % 7 <> 0 THEN ({KINDS})[greatest(event_id % 5 - 1, 0) + 1] || ':' || (event_id - 1) END AS prev, user_id % 4 AS n_prov FROM events)"""


@query("epistemic_violations", f"""WITH {RECORDS} SELECT 'InvalidConfidence' AS code, id AS source FROM rec WHERE k < 4 AND level <> ({list(validation.CONFIDENCE.values())})[k + 1]
    UNION ALL SELECT 'MissingProvenance', id FROM rec WHERE k IN (0, 4) AND n_prov = 0
    UNION ALL SELECT 'InvalidEpistemicDependency', id FROM rec WHERE prev IS NULL AND (k IN (2, 3) OR (k = 1 AND n_prov = 0))
    UNION ALL SELECT 'InvalidEvidenceReference', id FROM rec WHERE k = 4 AND prev IS NULL""")
def epistemic_violations(spark: SparkSession, d: str) -> DataFrame:
    return validation.epistemic_violations(epistemic_records(spark, d))


@query("basis_resolvability", f"""WITH {RECORDS} SELECT id AS record, prev AS ref FROM rec WHERE k IN (1, 2, 3) AND prev IS NOT NULL AND prev NOT IN (SELECT id FROM rec WHERE event_id % 3 <> 0)""")
def basis_resolvability(spark: SparkSession, d: str) -> DataFrame:
    """References of records, where every third event's record is not kept."""
    records = epistemic_records(spark, d)
    kept = records.where(F.split("id", ":")[1].cast("long") % 3 != 0)
    return validation.unresolved_basis(records.select(F.col("id").alias("record"), F.explode("based_on").alias("ref")), kept)


ATTRIBUTION = f"""WITH {RECORDS}, ref AS (SELECT id AS record, prev AS ref FROM rec WHERE k IN (1, 2, 3) AND prev IS NOT NULL)"""


@query("unattributed_records", ATTRIBUTION.replace("WITH", "WITH RECURSIVE", 1) + """, good AS (SELECT record FROM ref JOIN rec ON rec.id = ref.ref WHERE rec.k = 0 AND rec.event_id % 2 = 0 UNION SELECT ref.record FROM good JOIN ref ON ref.ref = good.record)
    SELECT DISTINCT record FROM ref WHERE record NOT IN (SELECT record FROM good)""")
def unattributed_records(spark: SparkSession, d: str) -> DataFrame:
    """Records from which no chain leads to an even event's fact."""
    records = epistemic_records(spark, d)
    known = records.where((F.col("kind") == "fact") & (F.split("id", ":")[1].cast("long") % 2 == 0))
    return validation.unattributed(records.select(F.col("id").alias("record"), F.explode("based_on").alias("ref")), known)


@query("provenance_roots", ATTRIBUTION + """ SELECT DISTINCT ref FROM ref WHERE ref NOT IN (SELECT record FROM ref) AND ref NOT IN (SELECT id FROM rec WHERE k = 0 AND event_id % 2 = 0)""")
def provenance_roots(spark: SparkSession, d: str) -> DataFrame:
    """What records rest on in the end and neither is a record nor an even event's fact."""
    records = epistemic_records(spark, d)
    known = records.where((F.col("kind") == "fact") & (F.split("id", ":")[1].cast("long") % 2 == 0))
    return validation.rootless(records.select(F.col("id").alias("record"), F.explode("based_on").alias("ref")), known)


def trace_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Runs, derivations of ten documents each, outputs, material entities and source files."""
    f = a.files(spark, d)
    run = F.concat(F.lit("run:"), (F.col("doc_id") % 3).cast("string"))
    runs = f.select(run.alias("id")).distinct().where("id <> 'run:2'")
    ref = lambda kind, value: F.struct(kind.alias("entity_type"), value.alias("entity_id"))
    kind = F.when(F.col("doc_id") % 4 == 0, "contract").otherwise("fact")
    entity = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    derivations = f.groupBy(F.concat(F.lit("derivation:"), F.floor(F.col("doc_id") / 10).cast("string"), F.lit("-"), (F.col("doc_id") % 3).cast("string")).alias("id"), run.alias("run_id")).agg(
        F.collect_list(ref(F.lit("source_file"), F.col("path"))).alias("inputs"), F.collect_list(ref(kind, entity)).alias("outputs"))
    outputs = f.select(run.alias("run_id"), F.when(F.col("doc_id") % 50 == 0, "summary").otherwise(kind).alias("entity_type"), F.concat(F.lit("doc:"), F.floor(F.col("doc_id") / F.when(F.col("doc_id") % 49 == 0, 2).otherwise(1)).cast("string")).alias("entity_id"))
    material = f.where("doc_id % 5 <> 0").select(kind.alias("entity_type"), entity.alias("entity_id"))
    return runs, derivations, outputs, material, f.where("doc_id % 7 <> 0").select("path")


@query("traceability_violations", sql("files", """WITH t AS (SELECT doc_id, path, 'run:' || (doc_id % 3) AS run, 'derivation:' || (doc_id // 10) || '-' || (doc_id % 3) AS der, CASE WHEN doc_id % 4 = 0 THEN 'contract' ELSE 'fact' END AS kind FROM files),
    outp AS (SELECT run || '|' || CASE WHEN doc_id % 50 = 0 THEN 'summary' ELSE kind END || '|doc:' || CASE WHEN doc_id % 49 = 0 THEN doc_id // 2 ELSE doc_id END AS k, run, CASE WHEN doc_id % 50 = 0 THEN 'summary' ELSE kind END AS kind FROM t),
    cover AS (SELECT kind, doc_id FROM t WHERE run = 'run:0')
    SELECT 'outputs' AS source, k AS missing FROM outp GROUP BY k HAVING count(*) > 1
    UNION ALL SELECT DISTINCT der, 'run:2' FROM t WHERE run = 'run:2' UNION ALL SELECT k, 'run:2' FROM outp WHERE run = 'run:2' UNION ALL SELECT k, 'summary' FROM outp WHERE kind = 'summary'
    UNION ALL SELECT der, 'doc:' || doc_id FROM t WHERE run = 'run:0' AND doc_id % 5 = 0 UNION ALL SELECT der, path FROM t WHERE run = 'run:0' AND doc_id % 7 = 0
    UNION ALL SELECT 'run:0', 'doc:' || doc_id FROM t WHERE doc_id % 5 <> 0 AND run <> 'run:0'"""))
def traceability_violations(spark: SparkSession, d: str) -> DataFrame:
    return validation.traceability_violations(*trace_tables(spark, d), current_run="run:0")


def scope_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents as scope entries whose evidence fits their status only sometimes."""
    f, k = a.files(spark, d), F.col("doc_id")
    item = lambda kind, code=None, severity=None, rule=None, file="path": F.struct(
        F.lit(kind).alias("kind"), (F.when(k % 31 == 0, "elsewhere").otherwise(F.col(file)) if code else F.lit(None).cast("string")).alias("file"), F.lit(code).cast("string").alias("code"), F.lit(severity).cast("string").alias("severity"), (F.when(k % 13 == 0, "oops").otherwise(F.lit(rule)) if rule else F.lit(None).cast("string")).alias("rule"))
    status = F.element_at(F.array(*map(F.lit, scope.STATUSES)), (k % 6 + 1).cast("int"))
    made = [(k % 6 == 0, item("analysis")), ((k % 6 == 3) & (k % 4 != 0), item("analysis")), ((k % 6 == 0) & (k % 12 == 0), item("issue", validation.FALLBACK, "RECOVERABLE")), ((k % 6).isin(0, 4) & (k % 5 == 0), item("issue", "compilation_failed", "RECOVERABLE")),
            ((k % 6).isin(0, 3) & (k % 7 != 0), item("issue", "unresolved_reference", "UNKNOWN")), ((k % 6 == 5) & (k % 5 != 0), item("run_error")), (k % 6 == 1, item("exclude_rule", rule="config:excludes:x")), ((k % 6 == 1) & (k % 8 == 1), item("size_limit")), ((k % 6 == 2) & (k % 9 != 2), item("walk_miss"))]
    evidence = F.filter(F.array(*[F.when(condition, value) for condition, value in made]), lambda x: x.isNotNull())
    return f.select(F.when(k % 97 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"), status.alias("status"), evidence.alias("evidence"))


@query("scope_violations", sql("files", """WITH s AS (SELECT doc_id AS k, doc_id % 6 AS m, CASE WHEN doc_id % 97 = 0 THEN '../' || path ELSE path END AS path FROM files),
    x AS (SELECT *, m = 0 AND k % 12 = 0 AS fallback, m IN (0, 4) AND k % 5 = 0 AS broken, m IN (0, 3) AND k % 7 <> 0 AS unknown FROM s)
    SELECT 'path' AS code, path AS source FROM x WHERE k % 97 = 0
    UNION ALL SELECT 'issue_attribution', path FROM x WHERE (fallback OR broken OR unknown) AND (k % 31 = 0 OR k % 97 = 0)
    UNION ALL SELECT 'evidence_missing', path FROM x WHERE (m = 3 AND NOT unknown) OR (m = 4 AND NOT broken) OR (m = 5 AND k % 5 = 0) OR (m = 2 AND k % 9 = 2)
    UNION ALL SELECT 'evidence_contradicted', path FROM x WHERE (m = 0 AND (unknown OR broken)) OR (m = 1 AND (k % 13 = 0 OR k % 8 = 1))"""))
def scope_violations(spark: SparkSession, d: str) -> DataFrame:
    made = scope_report(spark, d)
    paths = made.withColumn("evidence", F.transform("evidence", lambda e: e.withField("file", F.regexp_replace(e["file"], r"^\.\./", ""))))
    return validation.scope_violations(paths)


@query("scope_report_violations", sql("entries", """WITH c AS (SELECT count(*) FILTER (status = 'ANALYZED') AS analyzed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'UNRESOLVED') AS unresolved FROM entries)
    SELECT 'counts_inconsistent' AS code, 'report' AS source UNION ALL SELECT 'counts_inconsistent', 'report' UNION ALL SELECT 'run_binding', 'report' FROM c WHERE analyzed <> 0 OR unresolved <> 0"""))
def scope_report_violations(spark: SparkSession, d: str) -> DataFrame:
    """A failed run's report that counts one entry more than there are."""
    rows = scope.entries(scope.inventory(a.files(spark, d), ["**/*"], a.EXCLUDES, a.LIMIT_BYTES), a.issues(spark, d), scope.not_found(a.literals(spark, d), a.files(spark, d)))
    return validation.report_violations(scope.counts(rows), F.lit(rows.count() + 1), "FAILED", None, None)


@query("provenance_in_scope", sql("entries", """SELECT DISTINCT path FROM files WHERE doc_id % 3 = 0 AND path NOT IN (SELECT path FROM entries WHERE status IN ('ANALYZED', 'UNRESOLVED'))"""))
def provenance_in_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = scope.entries(scope.inventory(a.files(spark, d), ["**/*"], a.EXCLUDES, a.LIMIT_BYTES), a.issues(spark, d), scope.not_found(a.literals(spark, d), a.files(spark, d)))
    return validation.provenance_outside(a.files(spark, d).where("doc_id % 3 = 0"), rows)


@query("state_violations", sql("base_edges", """WITH ids AS (SELECT DISTINCT target AS id FROM base_edges UNION ALL SELECT 'contract:customer:' || c_custkey FROM customer, range(CASE WHEN c_custkey % 17 = 0 THEN 2 WHEN c_custkey % 13 = 0 THEN 0 ELSE 1 END) UNION ALL SELECT 'contract:supplier:' || s_suppkey FROM supplier),
    fact AS (SELECT event_id, 'fact:' || event_id AS id, 'contract:customer:' || user_id AS subject, event_type FROM events), obs AS (SELECT 'obs:' || event_id AS id, event_id FROM events WHERE event_type = 'purchase'),
    ev AS (SELECT 'ev:' || event_id AS id, 'obs:' || (event_id + 1) AS o FROM events WHERE event_type = 'click'),
    refs AS (SELECT 'relationship-endpoints' AS "check", 'rel:' || source AS source, unnest([source, target]) AS missing, 'e' AS held FROM base_edges UNION ALL SELECT 'fact-subject', id, subject, 'e' FROM fact UNION ALL SELECT 'fact-object', id, 'contract:none:' || event_id, 'e' FROM fact WHERE event_type = 'error'
        UNION ALL SELECT 'observation-basis', id, unnest(['fact:' || event_id, 'fact:' || (event_id * 2)]), 'f' FROM obs UNION ALL SELECT 'evidence-supports', id, o, 'c' FROM ev UNION ALL SELECT 'evidence-contradicts', id, replace(id, 'ev:', 'fact:'), 'c' FROM ev),
    held AS (SELECT DISTINCT id, 'e' AS held FROM ids UNION ALL SELECT id, unnest(['f', 'c']) FROM fact UNION ALL SELECT id, 'c' FROM obs)
    SELECT 0 AS rank, 0 AS place, 'DuplicateCanonicalEntity' AS code, 'unique' AS "check", id AS source, NULL::VARCHAR AS missing FROM ids GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 1, 0, 'InvalidConfidence', 'fact', id, NULL FROM fact WHERE event_id % 19 = 0 UNION ALL SELECT 2, 0, 'MissingProvenance', 'fact', id, NULL FROM fact WHERE event_id % 23 = 0
    UNION ALL SELECT 3, 0, 'InvalidReconState', "check", source, missing FROM refs ANTI JOIN held ON missing = held.id AND refs.held = held.held"""))
def state_violations(spark: SparkSession, d: str) -> DataFrame:
    """A state of five tables with ids that stand twice, wrong levels, lost provenance and lost references."""
    edges, e, s = a.base_edges(spark, d), load(spark, d, "events"), F.col("event_id").cast("string")
    customers = load(spark, d, "customer").withColumn("n", F.when(F.col("c_custkey") % 17 == 0, 2).when(F.col("c_custkey") % 13 == 0, 0).otherwise(1)).select(F.concat(F.lit("contract:customer:"), F.col("c_custkey").cast("string")).alias("id"), F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("id")
    contracts = edges.select(F.col("target").alias("id")).distinct().unionByName(customers).unionByName(load(spark, d, "supplier").select(F.concat(F.lit("contract:supplier:"), F.col("s_suppkey").cast("string")).alias("id")))
    facts = e.select(F.concat(F.lit("fact:"), s).alias("id"), F.concat(F.lit("contract:customer:"), F.col("user_id").cast("string")).alias("subject_id"), F.when(F.col("event_type") == "error", F.concat(F.lit("contract:none:"), s)).alias("object_id"),
                     F.when(F.col("event_id") % 19 == 0, "DERIVED").otherwise("VERIFIED").alias("level"), F.filter(F.array(F.lit("p")), lambda p: F.col("event_id") % 23 != 0).alias("provenance"))
    observations = e.where("event_type = 'purchase'").select(F.concat(F.lit("obs:"), s).alias("id"), F.array(F.concat(F.lit("fact:"), s), F.concat(F.lit("fact:"), (F.col("event_id") * 2).cast("string"))).alias("based_on"), F.lit("DERIVED").alias("level"))
    evidence = e.where("event_type = 'click'").select(F.concat(F.lit("ev:"), s).alias("id"), F.array(F.concat(F.lit("obs:"), (F.col("event_id") + 1).cast("string"))).alias("supports"), F.array(F.concat(F.lit("fact:"), s)).alias("contradicts"), F.array(F.lit("p")).alias("provenance"))
    relationships = edges.select(F.concat(F.lit("rel:"), "source").alias("id"), F.col("source").alias("source_id"), F.col("target").alias("target_id"))
    return state_check.state_violations({"contracts": contracts, "relationships": relationships, "facts": facts, "observations": observations, "evidence": evidence})


@query("issues_in_order", """WITH i AS (SELECT ['UNSUPPORTED', 'FATAL', 'UNKNOWN', 'RECOVERABLE'][event_id % 4 + 1] AS severity, event_type AS code, CASE WHEN user_id % 5 <> 0 THEN 'f' || user_id END AS file, CASE WHEN event_id % 7 <> 0 THEN event_id % 7 END AS line_start, event_id % 3 + 1 AS "count", props AS message FROM events)
    SELECT severity, code, coalesce(file, '') AS file, coalesce(line_start, 0) AS line_start, "count", message, row_number() OVER (ORDER BY list_position(['FATAL', 'RECOVERABLE', 'UNKNOWN', 'UNSUPPORTED'], severity), code, coalesce(i.file, ''), coalesce(i.line_start, 0), "count", message) AS place FROM i""")
def issues_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Events as issues, in the order in which a report lists them."""
    k = F.col("event_id")
    severity = F.element_at(F.array(*map(F.lit, ["UNSUPPORTED", "FATAL", "UNKNOWN", "RECOVERABLE"])), (k % 4 + 1).cast("int"))
    issues = load(spark, d, "events").select(
        severity.alias("severity"), F.col("event_type").alias("code"), F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("f"), F.col("user_id").cast("string"))).alias("file"),
        F.when(k % 7 != 0, k % 7).alias("line_start"), (k % 3 + 1).alias("count"), F.col("props").alias("message"))
    return order.issues_in_order(issues).fillna({"file": "", "line_start": 0})
