"""Edge, fact, issue and access aggregates; keep-first and keep-last; fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provloom.functions.canonical import fingerprint


def aggregate_edges(sites: DataFrame) -> DataFrame:
    """One edge per (type, source, target): sites, the first site's kind, and the sites' order."""
    order = F.struct("seq", "tie")
    return sites.groupBy("type", "source", "target").agg(
        F.count("*").alias("sites"), F.min_by("kind", order).alias("kind"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def aggregate_keyed_edges(sites: DataFrame) -> DataFrame:
    """``aggregate_edges`` over integer keys (type, s, t), seq under 2^25, tie under 2^31 and kinds of one ASCII character.

    The first site's order and kind are one number, so that the groups stay in hash
    aggregation.  A site outside these bounds stops the job; ``aggregate_edges`` has none.
    """
    packed = F.col("seq") * F.lit(1 << 38) + F.col("tie").cast("long") * 128 + F.ascii("kind")
    fits = F.col("seq").between(0, (1 << 25) - 1) & F.col("tie").between(0, (1 << 31) - 1) & (F.length("kind") == 1) & (F.ascii("kind") < 128)
    first = F.when(fits, packed).otherwise(F.raise_error(F.lit("a site out of the bounds of aggregate_keyed_edges")))
    found = sites.groupBy("type", "s", "t").agg(F.count("*").alias("sites"), F.min(first).alias("_first"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return found.select("type", "s", "t", "sites", F.chr(F.col("_first") % 128).alias("kind"), "first_seq", "last_seq")


def aggregate_facts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("subject", "predicate").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def issue_buckets(issues: DataFrame) -> DataFrame:
    """Per (code, file): count, first and last line."""
    return issues.groupBy("code", "file").agg(F.count("*").alias("n"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))


def access_groups(accesses: DataFrame) -> DataFrame:
    """Per (location, span): whether it is read and written, the operation, and its edges."""
    found = accesses.groupBy("location", "span").agg(F.bool_or(F.col("type") == "READS").alias("reads"), F.bool_or(F.col("type") == "WRITES").alias("writes"), F.count("*").alias("edges"))
    return found.withColumn("op", F.when(F.col("reads") & F.col("writes"), "readwrite").when(F.col("reads"), "read").otherwise("write"))


def grouped_by_consumers(uses: DataFrame) -> DataFrame:
    """Sources with the same set of consumers: (consumers, sources)."""
    lists = uses.groupBy("source").agg(F.array_sort(F.collect_set("consumer")).alias("consumers"))
    return lists.groupBy("consumers").agg(F.count("*").alias("sources"))


def read_write_sets(accesses: DataFrame) -> DataFrame:
    """Per function the sorted locations it reads, writes, and both."""
    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("location"))))
    found = accesses.groupBy("function").agg(pick("READS").alias("reads"), pick("WRITES").alias("writes"))
    return found.withColumn("readwrite", F.array_intersect("reads", "writes"))


def table_fingerprint(df: DataFrame, key: Column, value: Column, leaf_rows: int = 4096, max_depth: int | None = None) -> DataFrame:
    """One sha256 of a table's (key, value) lines, whatever their partitioning.

    A tree over the digits of the key's own hash: its depth follows from the number of rows,
    so that a leaf holds about ``leaf_rows`` lines and every other node sixteen digests.
    ``max_depth`` fixes where the tree ends for those who compare fingerprints of such a tree;
    from there on leaves grow with the table, by one line for every 16**max_depth.
    """
    lines = df.select(F.sha2(key, 256).alias("at"), key.alias("k"), F.concat(key, F.lit(" "), value).alias("line"))
    rows, depth = df.count(), 0
    while rows > leaf_rows * 16**depth and depth != max_depth:
        depth += 1
    if not depth:
        return lines.agg(fingerprint(F.col("line"), F.col("k")).alias("fingerprint"), F.count("*").alias("rows"))
    nodes = lines.groupBy(F.substring("at", 1, depth).alias("at")).agg(fingerprint(F.col("line"), F.col("k")).alias("digest"), F.count("*").alias("rows"))
    joined = F.concat("at", F.lit(" "), "digest")
    for digits in range(depth - 1, 0, -1):
        nodes = nodes.groupBy(F.substring("at", 1, digits).alias("up")).agg(fingerprint(joined, F.col("at")).alias("digest"), F.sum("rows").alias("rows")).withColumnRenamed("up", "at")
    return nodes.agg(fingerprint(joined, F.col("at")).alias("fingerprint"), F.sum("rows").alias("rows"))


def ratio(n: Column, d: Column, vacuous: int) -> tuple[Column, Column]:
    """Integer numerator and denominator; ``vacuous``/1 where the denominator is 0."""
    return F.when(d == 0, F.lit(vacuous)).otherwise(n).cast("long"), F.when(d == 0, F.lit(1)).otherwise(d).cast("long")


def union_of_basis(drafts: DataFrame) -> DataFrame:
    """Unknown drafts of one (record, field, reason) become one with the sorted union of their basis."""
    return drafts.groupBy("record", "field", "reason").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("basis")))).alias("basis"))
