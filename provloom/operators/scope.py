"""File-level scope accounting: inventory, status of every file, counts and integer ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.functions.text import first_match, glob_pattern
from provloom.operators.aggregate import ratio

STATUSES = ["ANALYZED", "EXCLUDED", "NOT_FOUND", "UNRESOLVED", "UNSUPPORTED", "FAILED"]
#: Folders that are never scanned, at any depth; a scan may name more.
ALWAYS_EXCLUDED = [".git", "node_modules"]


def inventory(files: DataFrame, includes: list[str], excludes: list[str], limit_bytes: int, never: list[str] = ALWAYS_EXCLUDED) -> DataFrame:
    """files(path, bytes, ...) that an include names, with the rule that excludes each, or null."""
    wanted = F.lit(False)
    for glob in includes:
        wanted = wanted | F.col("path").rlike(glob_pattern(glob))
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    always = F.coalesce(*[F.when(F.array_contains(folders, d), F.lit(f"always:{d}")) for d in never])
    too_large = F.when(F.col("bytes") > limit_bytes, F.lit("limit:maxFileBytes"))
    return files.where(wanted).withColumn("rule", F.coalesce(always, first_match(F.col("path"), excludes, "config:excludes:"), too_large))


def not_found(literals: DataFrame, files: DataFrame) -> DataFrame:
    """Literal includes (path) that no file has."""
    return literals.select("path").distinct().join(files.select("path"), "path", "left_anti")


def entries(inventoried: DataFrame, issues: DataFrame, missing: DataFrame, failed: bool = False) -> DataFrame:
    """(path, status, rule, issues): one row per file or missing literal.

    Precedence: excluded; then compilation failure; then, of a completed run, unknowns, else
    analyzed; of a failed run every other file failed.
    """
    per_file = issues.groupBy(F.col("file").alias("path")).agg(F.bool_or(F.col("code") == "compilation_failed").alias("_broken"), F.bool_or(F.col("severity") == "UNKNOWN").alias("_unknown"), F.count("*").alias("issues"))
    joined = inventoried.join(per_file, "path", "left")
    done = F.lit("FAILED") if failed else F.when(F.col("_unknown"), "UNRESOLVED").otherwise("ANALYZED")
    status = F.when(F.col("rule").isNotNull(), "EXCLUDED").when(F.col("_broken"), "UNSUPPORTED").otherwise(done)
    found = joined.select("path", status.alias("status"), "rule", F.when(F.col("rule").isNull(), F.coalesce("issues", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("issues"))
    return found.unionByName(missing.select("path", F.lit("NOT_FOUND").alias("status"), F.lit(None).cast("string").alias("rule"), F.lit(0).cast("long").alias("issues")))


def counts(rows: DataFrame) -> DataFrame:
    found = rows.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES], F.count("*").alias("_all"))
    return found.select(*[s.lower() for s in STATUSES], (F.col("_all") - F.col("excluded")).alias("expected"))


def metrics(rows: DataFrame) -> DataFrame:
    """Five integer ratios as (metric, n, d)."""
    c = counts(rows)
    made = {
        "clean_coverage": ratio(F.col("analyzed"), F.col("expected"), 1),
        "resolution_completeness": ratio(F.col("analyzed"), F.col("analyzed") + F.col("unresolved"), 1),
        "unsupported_rate": ratio(F.col("unsupported"), F.col("expected"), 0),
        "failed_rate": ratio(F.col("failed"), F.col("expected"), 0),
        "not_found_rate": ratio(F.col("not_found"), F.col("expected"), 0),
    }
    packed = F.array(*[F.struct(F.lit(k).alias("metric"), n.alias("n"), d.alias("d")) for k, (n, d) in made.items()])
    return c.select(F.explode(packed).alias("m")).select("m.*")


def excluded_by_rule(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'EXCLUDED'").groupBy("rule").agg(F.count("*").alias("n"))
