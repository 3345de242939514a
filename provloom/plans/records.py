"""Queries of record ids, provenance, unknowns, patches, the ladder and compositions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.operators import records, semantic
from provloom.plans import adapters as a
from provloom.plans import semantics as m
from provloom.plans.adapters import sql
from provloom.plans.registry import query
from provloom.storage import Scratch, load


def _ident(prefix: str, payload: str) -> str:
    return f"'{prefix}:' || substr(sha256({payload}), 1, 16)"


@query("record_content_ids", f"""WITH e AS (SELECT event_id, event_type AS t, 'function:' || user_id AS f, CASE WHEN user_id % 3 <> 0 THEN 'state:' || event_id END AS o, '["prov:' || least(event_id % 7, user_id % 5) || '","prov:' || greatest(event_id % 7, user_id % 5) || '"]' AS p FROM events)
    SELECT event_id, {_ident('rel', '''CASE WHEN o IS NULL THEN '{' ELSE '{"metadata":{"call_kind":"' || t || '"},' END || '"provenance":' || p || ',"source_id":"' || f || '","target_id":"' || coalesce(o, f) || '","type":"CALLS"}' ''')} AS rel_id,
        {_ident('fact', """'{"confidence":{"level":"VERIFIED"},' || CASE WHEN o IS NULL THEN '' ELSE '"object_id":"' || o || '",' END || '"predicate":"USES","provenance":' || p || ',"subject_id":"' || f || '","type":"FACT","value":"' || t || '"}'""")} AS fact_id,
        {_ident('obs', """'{"based_on":["' || f || '"],"confidence":{"level":"DERIVED"},"provenance":' || p || ',"statement":"' || t || '","type":"OBSERVATION"}'""")} AS obs_id,
        {_ident('asm', """'{"based_on":["' || f || '"],"confidence":{"level":"INFERRED"},"statement":"' || t || '","status":"OPEN","type":"ASSUMPTION"}'""")} AS asm_id,
        {_ident('hyp', """'{"affected_entities":["' || f || '"],"based_on":["' || f || '"],"confidence":{"level":"SPECULATIVE"},"required_conditions":[],"statement":"' || t || '","status":"OPEN","type":"HYPOTHESIS"}'""")} AS hyp_id,
        {_ident('evidence', """'{"contradicts":[],"description":"' || t || '","evidence_type":"code","provenance":' || p || ',"supports":["' || f || '"]}'""")} AS evidence_id FROM e""")
def record_content_ids(spark: SparkSession, d: str) -> DataFrame:
    """The six kinds of ids of records made of one event each; provenance comes unsorted."""
    e, f = load(spark, d, "events"), F.concat(F.lit("function:"), F.col("user_id").cast("string"))
    confidence = lambda level: F.struct(F.lit(level).alias("level"))
    base = e.select("event_id", F.col("event_type").alias("t"), f.alias("f"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("state:"), F.col("event_id").cast("string"))).alias("object_id"),
                    F.array(F.concat(F.lit("prov:"), (F.col("event_id") % 7).cast("string")), F.concat(F.lit("prov:"), (F.col("user_id") % 5).cast("string"))).alias("provenance"))
    made = {
        "rel": base.withColumns({"type": F.lit("CALLS"), "source_id": F.col("f"), "target_id": F.coalesce("object_id", "f"), "metadata": F.when(F.col("object_id").isNotNull(), F.struct(F.col("t").alias("call_kind")))}),
        "fact": base.withColumns({"type": F.lit("FACT"), "subject_id": F.col("f"), "predicate": F.lit("USES"), "value": F.col("t"), "confidence": confidence("VERIFIED")}),
        "obs": base.withColumns({"type": F.lit("OBSERVATION"), "statement": F.col("t"), "based_on": F.array("f"), "confidence": confidence("DERIVED")}),
        "asm": base.withColumns({"type": F.lit("ASSUMPTION"), "statement": F.col("t"), "based_on": F.array("f"), "confidence": confidence("INFERRED"), "status": F.lit("OPEN")}),
        "hyp": base.withColumns({"type": F.lit("HYPOTHESIS"), "statement": F.col("t"), "based_on": F.array("f"), "confidence": confidence("SPECULATIVE"), "status": F.lit("OPEN"), "affected_entities": F.array("f"), "required_conditions": F.array().cast("array<string>")}),
        "evidence": base.withColumns({"evidence_type": F.lit("code"), "description": F.col("t"), "supports": F.array("f"), "contradicts": F.array().cast("array<string>")}),
    }
    out = base.select("event_id")
    for kind, frame in made.items():
        out = out.join(frame.select("event_id", records.record_id(kind, frame).alias(f"{kind}_id")), "event_id")
    return out


@query("edge_provenance_lists", sql("edge_sites", """WITH s AS (SELECT type, source, target, kind || ':' || seq || '-' || tie AS span, min((seq, tie)) AS o FROM edge_sites GROUP BY ALL)
    SELECT type, source, target, string_agg(span, ',' ORDER BY o, span) AS provenance FROM s GROUP BY type, source, target"""))
def edge_provenance_lists(spark: SparkSession, d: str) -> DataFrame:
    sites = a.edge_sites(spark, d).withColumn("span", F.concat("kind", F.lit(":"), F.col("seq").cast("string"), F.lit("-"), F.col("tie").cast("string")))
    return records.edges_with_provenance(sites).withColumn("provenance", F.array_join("provenance", ","))


@query("provenance_registry", """SELECT DISTINCT 'prov:' || k AS id, 'file' || (k % 10) AS content FROM (SELECT event_id % 70 AS k FROM events UNION ALL SELECT user_id % 50 FROM events)""")
def provenance_registry(spark: SparkSession, d: str) -> DataFrame:
    one = lambda k: F.struct(F.concat(F.lit("prov:"), k.cast("string")).alias("id"), F.concat(F.lit("file"), (k % 10).cast("string")).alias("content"))
    return records.provenance_registry(load(spark, d, "events").select(F.array(one(F.col("event_id") % 70), one(F.col("user_id") % 50)).alias("provenance")))


@query("patch_lineage", """SELECT source AS patch, array_to_string(list_sort(list_distinct(list(lang) FILTER (lang IS NOT NULL))), ',') AS files, array_to_string(list_sort(list_distinct(list(lang || ':' || (doc_id % 9)) FILTER (lang IS NOT NULL))), ',') AS spans FROM documents GROUP BY source""")
def patch_lineage(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select(F.col("source").alias("patch"), F.col("lang").alias("file"), F.concat("lang", F.lit(":"), (F.col("doc_id") % 9).cast("string")).alias("span"))
    return records.patch_lineage(rows).withColumns({c: F.array_join(c, ",") for c in ("files", "spans")})


UNKNOWN_DRAFTS = f"""WITH {m.LAYERS}, du AS (SELECT record AS scope, 'unsupported_assembly' AS reason, id AS basis FROM live WHERE assembly AND NOT dropped
    UNION ALL SELECT id, 'dropped_file', id FROM live WHERE dropped
    UNION ALL SELECT 'boundary', 'out_of_scope_target', id FROM known WHERE type = 'CALLS' AND call_kind IS NOT NULL AND NOT known)"""


@query("esm_unknowns", UNKNOWN_DRAFTS + f""" SELECT DISTINCT {_ident('seme', """'{"basis":["' || basis || '"],"reason":"' || reason || '","scope":"' || scope || '"}'""")} AS id, scope, reason, basis FROM du""")
def esm_unknowns(spark: SparkSession, d: str) -> DataFrame:
    """Unknown records of transitions and of calls whose target is not known."""
    of_files = semantic.file_unknowns(m.functions(spark, d), m.file_issues(spark, d)).select(F.col("record_ref").alias("scope"), "reason", "basis")
    calls = m.relationships(spark, d).where("type = 'CALLS' and call_kind is not null").join(m.functions(spark, d).select(F.col("id").alias("target")), "target", "left_anti")
    found = records.unknowns(of_files, calls.select(F.lit("boundary").alias("scope"), F.lit("out_of_scope_target").alias("reason"), F.array("id").alias("basis")))
    return found.withColumn("basis", F.array_join("basis", ","))


def uses(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups as emitted events, errors as uses of errors; every eighth is not resolved."""
    e = load(spark, d, "events").where("event_type in ('signup', 'error')")
    line = F.col("event_id") % 30
    return e.select(F.when(F.col("event_type") == "signup", "event").otherwise("error").alias("kind"), F.concat(F.lit("function:"), (F.col("user_id") % 40).cast("string")).alias("subject"),
                    F.when(F.col("event_id") % 8 != 0, F.concat(F.lit("S"), (F.col("event_id") % 6).cast("string"), F.lit("(uint256)"))).alias("signature"), F.concat(F.lit("e"), (F.col("user_id") % 20).cast("string")).alias("file"), line.alias("line_start"), (line + 1).alias("line_end"), F.col("event_id").alias("seq"))


USED = """WITH u AS (SELECT event_id AS seq, event_type = 'signup' AS ev, 'function:' || (user_id % 40) AS subject, CASE WHEN event_id % 8 <> 0 THEN 'S' || (event_id % 6) || '(uint256)' END AS signature, 'e' || (user_id % 20) AS file, event_id % 30 AS ls, event_id % 30 + 1 AS le FROM events WHERE event_type IN ('signup', 'error'))"""


@query("event_error_facts", USED + """ SELECT subject AS subject_id, CASE WHEN ev THEN 'EMITS' ELSE 'USES' END AS predicate, CASE WHEN ev THEN signature ELSE 'custom-error:' || signature END AS value,
    string_agg(file || ':' || ls || '-' || le, ',' ORDER BY seq) AS provenance FROM u WHERE signature IS NOT NULL GROUP BY subject, ev, signature""")
def event_error_facts(spark: SparkSession, d: str) -> DataFrame:
    return records.event_error_patch(uses(spark, d))[0].withColumn("provenance", F.array_join("provenance", ","))


@query("event_error_issues", USED + """ SELECT CASE WHEN ev THEN 'event_unresolved' ELSE 'error_unresolved' END AS code, file, 'UNKNOWN' AS severity, count(*) AS n, min(ls) AS line_start, max(le) AS line_end FROM u WHERE signature IS NULL GROUP BY ev, file""")
def event_error_issues(spark: SparkSession, d: str) -> DataFrame:
    return records.event_error_patch(uses(spark, d))[1]


PATCHES = """WITH p AS (SELECT o_orderkey AS id, 0 AS k, o_orderstatus AS content FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 1, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END FROM orders WHERE o_orderkey % 2 = 0)"""


def _patches(spark: SparkSession, d: str) -> list[DataFrame]:
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("content"))
    changed = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 7 == 0, "X").otherwise(F.col("content"))
    return [o.where("id % 3 <> 0"), o.where("id % 2 = 0").withColumn("content", changed)]


@query("patch_merge", PATCHES + " SELECT id, list(content ORDER BY k)[1] AS content FROM p GROUP BY id")
def patch_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two patches' records, the first of each id."""
    return records.merge_patches(_patches(spark, d))[0]


@query("patch_conflicts", PATCHES + " SELECT id FROM p GROUP BY id HAVING count(DISTINCT coalesce(content, '-')) > 1")
def patch_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Ids that the two patches give different contents; none is a content of its own."""
    return records.merge_patches(_patches(spark, d))[1]


LADDER = f"""WITH {m.LAYERS}, src AS (SELECT 'Function f' || substr(t.function_id, 10) || ' reads ' || CASE WHEN reads = '' THEN 0 ELSE len(string_split(reads, ',')) END || ' state variables and writes ' || CASE WHEN writes = '' THEN 0 ELSE len(string_split(writes, ',')) END || ' state variables' AS statement, f.ids
        FROM tr t JOIN (SELECT subject, string_agg(DISTINCT id, '","' ORDER BY id) AS ids FROM fact GROUP BY subject) f ON f.subject = t.function_id),
    ob AS (SELECT DISTINCT {_ident('semobs', """'{"based_on":["' || ids || '"],"statement":"' || statement || '"}'""")} AS id, statement, replace(ids, '","', ',') AS based_on FROM src)"""


def _ladder(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    made = semantic.state_transitions(m.functions(spark, d), m.relationships(spark, d), m.function_facts(spark, d), m.file_issues(spark, d))[0]
    named = made.join(m.functions(spark, d).select(F.col("id").alias("function_id"), "name"), "function_id")
    held = m.function_facts(spark, d).groupBy(F.col("subject").alias("function_id")).agg(F.collect_set("id").alias("facts"))
    return records.ladder(named.join(held, "function_id").select(records.transition_statement().alias("statement"), "facts"))


@query("ladder_observations", LADDER + " SELECT id, statement, based_on, 'DERIVED' AS level FROM ob")
def ladder_observations(spark: SparkSession, d: str) -> DataFrame:
    """One observation per transition that facts bear."""
    return _ladder(spark, d)[0].withColumn("based_on", F.array_join("based_on", ","))


@query("ladder_assumptions", LADDER + f""", s AS (SELECT id, 'Security assumption: the behavior observed in ' || id || ' holds under operational conditions' AS statement FROM ob)
    SELECT {_ident('semasm', """'{"based_on":["' || id || '"],"statement":"' || statement || '"}'""")} AS id, statement, id AS based_on, 'INFERRED' AS level, 'OPEN' AS status FROM s""")
def ladder_assumptions(spark: SparkSession, d: str) -> DataFrame:
    return _ladder(spark, d)[1].withColumn("based_on", F.array_join("based_on", ","))


@query("record_owners", f"""WITH {m.LAYERS}, tagged AS (SELECT source AS f, 'access' AS tag, id FROM rel WHERE type <> 'CALLS' UNION SELECT source, 'boundary', id FROM rel WHERE type = 'CALLS' AND call_kind = 'external'
    UNION SELECT unnest([source, target]), 'influence', id FROM rel WHERE type = 'CALLS' UNION SELECT source, 'path', id FROM rel WHERE type = 'CALLS') SELECT f AS function_id, tag, id AS record FROM tagged WHERE f IN (SELECT id FROM fn)""")
def record_owners(spark: SparkSession, d: str) -> DataFrame:
    r = m.relationships(spark, d).withColumn("record", F.col("id"))
    calls = r.where("type = 'CALLS'")
    return records.owners(m.functions(spark, d), r.where("type <> 'CALLS'"), calls.where("call_kind = 'external'"), calls.select(F.col("source").alias("writer"), F.col("target").alias("reader"), "record"), calls.select(F.array("source", "target").alias("path"), "record")).select("function_id", "tag", "record")


SUCCESSORS = f"""WITH {m.LAYERS}, suc AS (SELECT source AS function_id, id AS site, CASE WHEN call_kind IS NULL OR known OR call_kind = 'internal' THEN 'call-inline' ELSE 'callback-reentry' END AS operator, CASE WHEN known AND call_kind IS NOT NULL THEN target END AS target FROM known WHERE type = 'CALLS'
    UNION ALL SELECT subject, fact.id, 'callback-reentry', NULL FROM fact JOIN fn ON fn.id = subject WHERE mark IS NOT NULL
    UNION ALL SELECT fn.id, 'rel:i' || c_custkey, 'inherit-merge', 'contract:nation:' || c_nationkey FROM fn JOIN customer ON 'contract:customer:' || c_custkey = contract_id)"""


def _successors(spark: SparkSession, d: str) -> DataFrame:
    bases = load(spark, d, "customer").select(F.concat(F.lit("rel:i"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("contract:customer:"), F.col("c_custkey").cast("string")).alias("source"), F.concat(F.lit("contract:nation:"), F.col("c_nationkey").cast("string")).alias("target"))
    marked = m.function_facts(spark, d).where(F.col("predicate").isin("CALLS", "DELEGATES_TO") & F.col("value").isin(list(semantic.MARKERS)))
    return records.successors(m.relationships(spark, d).where("type = 'CALLS'"), marked, bases, m.functions(spark, d))


@query("composition_successors", SUCCESSORS + " SELECT function_id, site, operator, target FROM suc")
def composition_successors(spark: SparkSession, d: str) -> DataFrame:
    return _successors(spark, d)


@query("compositions", SUCCESSORS.replace("WITH", "WITH RECURSIVE", 1) + """, w AS (SELECT fn.id AS root, 1 AS depth, [fn.id] AS chain, operator, site, target, CASE WHEN target IS NULL THEN 'unresolved' WHEN target = fn.id THEN 'cyclic' ELSE 'taken' END AS flag FROM fn JOIN suc ON suc.function_id = fn.id
    UNION ALL SELECT root, depth + 1, list_append(chain, w.target), s.operator, s.site, s.target, CASE WHEN s.target IS NULL THEN 'unresolved' WHEN list_contains(list_append(chain, w.target), s.target) THEN 'cyclic' WHEN depth + 1 > 8 THEN 'bound-hit' ELSE 'taken' END FROM w JOIN suc s ON s.function_id = w.target WHERE flag = 'taken')
    SELECT root, depth, array_to_string(chain, '>') AS chain, operator, site, flag FROM w""")
def compositions(spark: SparkSession, d: str) -> DataFrame:
    """The chains by which composing every function goes on, eight calls deep."""
    found = records.compositions(m.functions(spark, d).select("id"), _successors(spark, d), Scratch(spark, "compositions"))
    return found.select("root", "depth", F.array_join("chain", ">").alias("chain"), "operator", "site", "flag")
