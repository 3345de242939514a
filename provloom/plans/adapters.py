"""The driver's tables seen as entities, edges, facts, files, issues, runs and chains.

Each view comes twice: as a DataFrame and as a SQL text for a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.functions.canonical import canonical_json
from provloom.storage import load

EXCLUDES = ["src0/**", "**/1?.txt"]
LIMIT_BYTES = 8000


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def base_edges(spark: SparkSession, d: str) -> DataFrame:
    """customer and supplier → nation → region."""
    pick = lambda t, s, sp, g, gp: load(spark, d, t).select(F.lit("INHERITS").alias("type"), _id(sp, s).alias("source"), _id(gp, g).alias("target"), F.col(s).cast("long").alias("seq"), F.lit("base").alias("kind"), F.lit(0).cast("long").alias("tie"))
    return pick("nation", "n_nationkey", "contract:nation:", "n_regionkey", "contract:region:").unionByName(
        pick("customer", "c_custkey", "contract:customer:", "c_nationkey", "contract:nation:")).unionByName(
        pick("supplier", "s_suppkey", "contract:supplier:", "s_nationkey", "contract:nation:"))


def call_sites(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.lit("CALLS").alias("type"), _id("function:", "l_orderkey").alias("source"), _id("contract:supplier:", "l_suppkey").alias("target"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_linestatus").alias("kind"), F.col("l_partkey").cast("long").alias("tie"))


def access_sites(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "READS").otherwise("WRITES")
    return load(spark, d, "lineitem").select(kind.alias("type"), _id("function:", "l_orderkey").alias("source"), _id("state:", "l_partkey").alias("target"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").cast("long").alias("tie"))


def edge_sites(spark: SparkSession, d: str) -> DataFrame:
    return base_edges(spark, d).unionByName(call_sites(spark, d)).unionByName(access_sites(spark, d))


def facts(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    predicate = F.when(e == "purchase", "WRITES").when(e == "view", "READS").when(e == "click", "CALLS").when(e == "signup", "EMITS").otherwise("USES")
    return load(spark, d, "events").select(F.col("user_id").alias("subject"), predicate.alias("predicate"), F.col("event_id").alias("seq"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """documents as files; the hash stands for the content."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return load(spark, d, "documents").select("doc_id", path.alias("path"), F.sha2(F.col("text"), 256).alias("sha256"), F.col("n_chars").alias("bytes"))


def issues(spark: SparkSession, d: str) -> DataFrame:
    """labels as issues of files: quality 0 fails to compile, toxic is unknown."""
    rows = load(spark, d, "labels").join(files(spark, d).select("doc_id", "path"), "doc_id")
    made = F.array(F.when(F.col("quality") == 0, F.struct(F.lit("compilation_failed").alias("code"), F.lit("RECOVERABLE").alias("severity"))), F.when(F.col("toxic") == 1, F.struct(F.lit("unresolved_reference").alias("code"), F.lit("UNKNOWN").alias("severity"))))
    return rows.select("path", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("i")).select(F.col("path").alias("file"), "i.code", "i.severity")


def literals(spark: SparkSession, d: str) -> DataFrame:
    """Literal includes; those of every 97th document, and as many that do not exist."""
    every = files(spark, d).where("doc_id % 97 = 0")
    return every.select("path").unionByName(every.select(F.concat(F.lit("missing/"), "path").alias("path")))


def run_outputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    entity = F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("entity_id")
    made = files(spark, d).select("doc_id", entity, F.col("sha256").alias("content_hash"))
    b = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("content_hash", F.lit("!")), 256)).otherwise(F.col("content_hash"))
    return made.where("doc_id % 10 <> 0"), made.where("doc_id % 10 <> 1").withColumn("content_hash", b)


def turns(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select("conv_id", "turn", _node(F.col("conv_id"), F.col("turn")).alias("node")).distinct()


def _node(conv, turn):
    return F.concat_ws(":", conv.cast("string"), turn.cast("string"))


def chain(spark: SparkSession, d: str, skip: int = 1) -> DataFrame:
    """(source, target): each turn to the next (and up to ``skip`` turns on)."""
    t = turns(spark, d)
    steps = t.select("conv_id", F.col("node").alias("source"), F.explode(F.sequence(F.lit(1), F.lit(skip))).alias("step"), "turn").select("conv_id", "source", (F.col("turn") + F.col("step")).alias("turn"))
    return steps.join(t, ["conv_id", "turn"]).select("source", F.col("node").alias("target"))


def first_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("conv_id").agg(F.min("turn").alias("turn")).select(_node(F.col("conv_id"), F.col("turn")).alias("root"))


def edge_payload():
    return canonical_json(type=F.col("type"), source_id=F.col("source"), target_id=F.col("target"))


CTE = {
    "base_edges": """base_edges AS (
        SELECT 'INHERITS' AS type, 'contract:nation:' || n_nationkey AS source, 'contract:region:' || n_regionkey AS target, n_nationkey::BIGINT AS seq, 'base' AS kind, 0::BIGINT AS tie FROM nation
        UNION ALL SELECT 'INHERITS', 'contract:customer:' || c_custkey, 'contract:nation:' || c_nationkey, c_custkey::BIGINT, 'base', 0::BIGINT FROM customer
        UNION ALL SELECT 'INHERITS', 'contract:supplier:' || s_suppkey, 'contract:nation:' || s_nationkey, s_suppkey::BIGINT, 'base', 0::BIGINT FROM supplier)""",
    "call_sites": """call_sites AS (
        SELECT 'CALLS' AS type, 'function:' || l_orderkey AS source, 'contract:supplier:' || l_suppkey AS target, l_linenumber::BIGINT AS seq, l_linestatus AS kind, l_partkey::BIGINT AS tie FROM lineitem)""",
    "access_sites": """access_sites AS (
        SELECT CASE WHEN l_returnflag = 'N' THEN 'READS' ELSE 'WRITES' END AS type, 'function:' || l_orderkey AS source, 'state:' || l_partkey AS target, l_linenumber::BIGINT AS seq, l_returnflag AS kind, l_suppkey::BIGINT AS tie FROM lineitem)""",
    "edge_sites": """edge_sites AS (SELECT * FROM base_edges UNION ALL SELECT * FROM call_sites UNION ALL SELECT * FROM access_sites)""",
    "facts": """facts AS (
        SELECT user_id AS subject, CASE event_type WHEN 'purchase' THEN 'WRITES' WHEN 'view' THEN 'READS' WHEN 'click' THEN 'CALLS' WHEN 'signup' THEN 'EMITS' ELSE 'USES' END AS predicate, event_id AS seq FROM events)""",
    "files": """files AS (
        SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS sha256, n_chars AS bytes FROM documents)""",
    "issues": """issues AS (
        SELECT path AS file, 'compilation_failed' AS code, 'RECOVERABLE' AS severity FROM labels JOIN files USING (doc_id) WHERE quality = 0
        UNION ALL SELECT path, 'unresolved_reference', 'UNKNOWN' FROM labels JOIN files USING (doc_id) WHERE toxic = 1)""",
    "literals": """literals AS (
        SELECT path FROM files WHERE doc_id % 97 = 0 UNION ALL SELECT 'missing/' || path FROM files WHERE doc_id % 97 = 0)""",
    "inventory": """inventory AS (
        SELECT *, CASE WHEN regexp_matches(path, '^src0/.*$') THEN 'config:excludes:src0/**' WHEN regexp_matches(path, '^(?:.*/)?1[^/]\\.txt$') THEN 'config:excludes:**/1?.txt'
                       WHEN bytes > 8000 THEN 'limit:maxFileBytes' END AS rule FROM files)""",
    "entries": """entries AS (
        SELECT i.path, CASE WHEN rule IS NOT NULL THEN 'EXCLUDED' WHEN broken THEN 'UNSUPPORTED' WHEN unknown THEN 'UNRESOLVED' ELSE 'ANALYZED' END AS status, rule,
               CASE WHEN rule IS NULL THEN coalesce(n, 0) ELSE 0 END::BIGINT AS issues
        FROM inventory i LEFT JOIN (SELECT file, bool_or(code = 'compilation_failed') AS broken, bool_or(severity = 'UNKNOWN') AS unknown, count(*) AS n FROM issues GROUP BY file) p ON p.file = i.path
        UNION ALL SELECT DISTINCT l.path, 'NOT_FOUND', NULL, 0::BIGINT FROM literals l WHERE l.path NOT IN (SELECT path FROM files))""",
    "run_a": """run_a AS (SELECT 'doc:' || doc_id AS entity_id, sha256 AS content_hash FROM files WHERE doc_id % 10 <> 0)""",
    "run_b": """run_b AS (SELECT 'doc:' || doc_id AS entity_id, CASE WHEN doc_id % 7 = 0 THEN sha256(sha256 || '!') ELSE sha256 END AS content_hash FROM files WHERE doc_id % 10 <> 1)""",
    "turns": """turns AS (SELECT DISTINCT conv_id, turn, conv_id || ':' || turn AS node FROM conversations)""",
    "chain": """chain AS (SELECT a.node AS source, b.node AS target FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""",
    "chain2": """chain2 AS (SELECT a.node AS source, b.node AS target FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn + 1 AND a.turn + 2)""",
    "first_turns": """first_turns AS (SELECT conv_id || ':' || min(turn) AS root FROM turns GROUP BY conv_id)""",
}
NEEDS = {
    "edge_sites": ["base_edges", "call_sites", "access_sites"], "issues": ["files"], "literals": ["files"], "inventory": ["files"],
    "entries": ["inventory", "issues", "literals"], "run_a": ["files"], "run_b": ["files"], "chain": ["turns"], "chain2": ["turns"], "first_turns": ["turns"],
}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """``body`` under the named views, in the order that they need each other."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for view in views.split():
        add(view)
    texts = [CTE[v] for v in order]
    if body.lstrip().upper().startswith("WITH "):
        texts.append(body.lstrip()[5:])
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(texts)
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(texts) + "\n" if texts else "") + body
